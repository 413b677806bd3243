"""Evidence analytics on Spark: located text, citable evidence, statements and class hierarchies as DataFrame plans."""
