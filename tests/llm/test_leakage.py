import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.llm.leakage import _codes, _streams, equal_run, free_template, kept_windows, leaked, same_question, stream


def brute(a, b, least):
    best = 0
    for i in range(len(a)):
        while i + best + 1 <= len(a) and a[i : i + best + 1] in b:
            best += 1
    return best if best >= least else 0


@settings(max_examples=60, deadline=None)
@given(st.text("ab1", max_size=40), st.text("ab1", max_size=40), st.integers(1, 8))
def test_equal_run(a, b, least):
    assert equal_run(_codes(a), _codes(b), range(-len(b), len(a) + 1), least) == brute(a, b, least)


@settings(max_examples=200, deadline=None)
@given(st.text("ab1 3.m,k-%甲 \ue002", max_size=30))
def test_both_ways_make_one_template(text):
    codes = _streams([text], 3)
    for code, want in zip(codes, (stream(text), free_template(text)[0]), strict=True):
        got = "".join(map(chr, code[3:].astype(int)))
        assert got == want


def test_a_shared_run_always_shares_a_kept_window():
    rng = random.Random(4)
    letters = "abcdefgh0123456789甲乙丙丁"
    for _ in range(60):
        core = "".join(rng.choices(letters, k=40))
        doc = "".join(rng.choices(letters, k=rng.randrange(80))) + core + "".join(rng.choices(letters, k=rng.randrange(80)))
        item = "".join(rng.choices(letters, k=rng.randrange(30))) + core
        _, family, place, kept = kept_windows([doc], False, 20, 40)
        _, family_i, place_i, every = kept_windows([item], True, 20, 40)
        assert np.isin(kept[family == 0], every[family_i == 0]).any()
        shifts = {int(x - y) for x, h in zip(place[family == 0], kept[family == 0], strict=True) for y, g in zip(place_i[family_i == 0], every[family_i == 0], strict=True) if g == h}
        assert equal_run(_codes(doc), _codes(item), shifts, 40) >= 40


def alike(a: str, b: str, least: int = 10) -> int:
    (x, p), (y, q) = free_template(a), free_template(b)
    return same_question((_codes(x), p), (_codes(y), q), range(-len(y), len(x) + 1), least)


def test_slots():
    a = "Pump PCM115 leaked 29.36 marks at 9346 spots, who signs?"
    b = "Pump XYZ22 leaked 4.1 marks at 12 spots, who signs?"
    assert free_template(a)[0] == free_template(b)[0] and alike(a, b) == len(free_template(a)[0])
    assert not alike("sums of 3 with 3", "sums of 4 with 5", 12) and not alike("sums of 3 with 7", "sums of 5 with 5", 12) and alike("sums of 3 with 7", "sums of 5 with 6", 12)
    assert alike("sums of 3 with 3 and 4", "sums of 5 with 5 and 4") and not alike(a, a)
    # Beyond a slot that does not fit, the longer consistent part counts.
    assert alike("of 3 with 3, so the whole crew closes 8 valves", "of 4 with 5, so the whole crew closes 9 valves") == len("withsothewholecrewcloses") + 2 + len("valves")
    # The second place in a document may fit where the first does not.
    assert alike("add 1 and 1 now! add 7 and 8 now!", "add 3 and 4 now") and not alike("1 2 3 4 5 6", "6 5 4 3 2 1", 4)


WORDS = "crew pump valve gasket shell tube plate signs checks closes drains before after each lower upper cover flange slowly twice".split()


def test_changed_questions_are_found(spark):
    rng = random.Random(7)
    slot = lambda: rng.choice([f"{rng.randrange(10, 99999)}", f"{rng.randrange(1, 99)}.{rng.randrange(1, 99)} mm", f"{''.join(rng.choices('ABCDEFGH', k=3))}-{rng.randrange(100, 9999)}"])
    items, docs, want = [], [], set()
    for k in range(60):
        words = [rng.choice(WORDS) if i % 4 else "{}" for i in range(25)]
        kinds = [slot() for w in words if w == "{}"]
        change = lambda v: "".join(rng.choice("123456789") if c.isdigit() else c for c in v)
        items.append((f"i{k}", " ".join(words).format(*kinds)))
        said = " ".join(words).format(*map(change, kinds)).split(" ")
        part = said if k % 2 else said[: len(said) * 3 // 4]
        docs.append((k, " ".join([*rng.choices(WORDS, k=30), *part, *rng.choices(WORDS, k=30)])))
        want.add((k, f"i{k}"))
    docs += [(1000 + k, " ".join(rng.choices(WORDS, k=120))) for k in range(60)]
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in leaked(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()}
    found = {k for k, kind in got.items() if kind == "reworded values"}
    assert len(found & want) >= 0.9 * len(want) and not set(got) - want


def test_leaked(spark):
    item = "Once vendor 7019 was replaced, crystals grew on 7341 tube ends (KUW111) and gauge 5966 drifted by 72.64 marks"
    docs = [
        (1, f"Before. {item.upper()}! After."), (2, "nothing of the kind"), (3, None), (4, ""), (5, item.replace("7019", "12").replace("KUW111", "ABC5")),
        (6, "x" + stream(item)[:39] + "y"), (None, item), (7, "ｘ " + " ".join(item)), (1, f"Before. {item.upper()}! After."),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame([("i1", item, "en"), ("i2", None, "en"), ("i3", "short", "en")], "item_id string, text string, lang string")
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in leaked(df, items).collect()}
    assert got == {(1, "i1"): "verbatim", (7, "i1"): "verbatim", (5, "i1"): "reworded values"}
    other = spark.createDataFrame([(9, "Once vendor 1 was replaced, crystals grew on 2 tube ends (ABC9) and gauge 3 drifted by 4.5 marks")], "doc_id bigint, text string")
    assert [r["kind"] for r in leaked(other, items).collect()] == ["reworded values"]
    assert leaked(df.limit(0), items).count() == 0
    assert leaked(df, items.limit(0)).count() == 0
