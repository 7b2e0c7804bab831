
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymark.llm import canon, lookalike, names, packing, quantiles, residue, tokenizer

VOCABULARY = tokenizer.DEFAULT_VOCABULARY
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file here")


# 1: reference list

CITIES = [(1, "city", "Upper Bren", ["Xanadu"], "Velland"), (2, "city", "Bren", None, "Velland"), (3, "city", "Port Hólmar-on-Sea", None, None), (4, "city", "Upper Kastor", None, None), (5, "city", "Upper Mirna", None, None), (6, "brand", "Tolvek & Sons", ["Tolvek"], None), (7, "city", "Stolgrind", None, None), (8, "city", "Port Sela", None, None), (9, "city", "Port Arum", None, None)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("UPPER BREN", 1), ("Bren, Upper", 1), ("  in Bren, Velland", 2), ("Lower Bren", 2), ("Port Bren", -1), ("Up. Bren", 1), ("xanadu", 1), ("The city is Stolgrnid.", 7), ("Stol grind", 7), ("stolgrind!", 7),
        ("port holmar on sea", 3), ("Ｐｏｒｔ Hólmar-on-Sea", 3), ('{"label": "Upper Kastr"}', 4), ("12345 Upper Mirna", 5), ("Tolvek", -1), ("unknown", -1), ("The text names no city.", -1), ("", -1), ("?", -1), ("Zzyzx", -1), ("x" * 100_000, -1),
    ],
)
def test_city_matching(text, want):
    assert canon.CanonMatcher(CITIES).match("city", text) == want


def test_canon_kinds_blocks_and_nulls(spark):
    list_ = spark.createDataFrame(CITIES, "canon_id bigint, kind string, value string, aliases array<string>, country string")
    rows = [("label", 1, "city", "bren"), ("label", 1, "city", "bren"), ("label", 2, "city", "Bren"), ("label", 3, "city", None), ("label", 4, "city", " 　\t"), ("label", 5, "brand", "tolvek"), ("p", 1, "color", "red"), ("p", 2, "city", "BREN")]
    records = spark.createDataFrame(rows, "record_kind string, record_id bigint, kind string, text string")
    got = {(r.record_kind, r.record_id): r.canon_id for r in canon.free_values(records, list_).collect()}
    assert got == {("label", 1): 2, ("label", 5): 6, ("p", 1): -1, ("p", 2): 2}
    assert canon.free_values(records.limit(0), list_).count() == 0
    assert {r.canon_id for r in canon.free_values(records, list_.limit(0)).collect()} == {-1}
    values = spark.createDataFrame([("city", "bren", 5)], "kind string, text string, canon_id int")
    assert canon.map_to_canon(values, list_, block=4).first().canon_id == 2


def test_blocks_give_the_answers_of_one_block(spark, sf):
    list_ = spark.read.parquet(f"{sf}/canonical_values.parquet")
    values = spark.read.parquet(f"{sf}/labels.parquet").selectExpr("use_case AS kind", "value AS text", "label_id").unionByName(
        spark.read.parquet(f"{sf}/predictions.parquet").selectExpr("use_case AS kind", "predicted_value AS text", "prediction_id AS label_id")
    ).where("kind IN ('city', 'brand', 'job_title')")
    whole = {(r.kind, r.text, r.label_id): (r.canon_id, r.tied) for r in canon.map_to_canon(values, list_, ties=True).collect()}
    for block in (100, 300):
        assert {(r.kind, r.text, r.label_id): (r.canon_id, sorted(r.tied)) for r in canon.map_to_canon(values, list_, block, ties=True).collect()} == whole


@pytest.mark.parametrize("n", [30, 64, 300])
def test_long_lists_keep_their_matches(n):
    letters = "abcdefghijklmnopqrst"
    entries = [(i, "city", f"port{letters[i // 20]}{letters[i % 20]}on harbor", None, None) for i in range(n)]
    m = canon.CanonMatcher(entries)
    assert [m.match("city", f"harbor port{letters[i // 20]}{letters[i % 20]}on") for i in range(n)] == list(range(n))
    assert m.match("city", "h portabon") == 1


def test_tied_names_are_reported(spark):
    rows = [(1, "city", "Mirna", ["Old Town"], "Velland"), (2, "city", "Sela", ["Old Town"], "Tarland"), (3, "city", "Bren", ["Sela"], None)]
    m = canon.CanonMatcher(rows)
    assert m.match_or_ties("city", "old town") == (-1, [1, 2]) and m.match("city", "Old Town, Tarland") == 2 and m.match("city", "sela") == 2
    list_ = spark.createDataFrame(rows, "canon_id bigint, kind string, value string, aliases array<string>, country string")
    records = spark.createDataFrame([("label", 1, "city", "old town"), ("label", 2, "city", "old town"), ("label", 3, "city", "zzz")], "record_kind string, record_id bigint, kind string, text string")
    assert {r.text: (sorted(r.tied), r.n) for r in canon.unmatched(records, list_).collect()} == {"old town": ([1, 2], 2), "zzz": ([], 1)}


@settings(max_examples=150, deadline=None)
@given(st.text("abcd", max_size=7), st.text("abcd", max_size=7))
def test_edits(a, b):
    d = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            d[i, j] = max(i, j) if not i or not j else min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    assert canon.edits(a, b, 9) == d[len(a), len(b)]
    assert canon.edits(a, b, 1) == min(2, d[len(a), len(b)])


# 3: look-alikes


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("Ａｂ　１", "Ab 1", True), ("a​b­", "ab", True), ("café", "café", True), ("сорe", "cope", True), ("ﬁne", "fine", True), ("a b", "a b", True), ("Kite", "Kite", True), ("ⅿodeⅼ", "model", True), ("чайник", "чайник", True), ("on‑sea", "on-sea", True), ("ｶﾞﾊﾟ", "ガパ", True), ("カﾞ", "ガ", True), ("ｶ", "ガ", False), ("5 µm", "5 μm", True), ("ｱﾞ", "ア゙", True),
        ("A", "a", False), ("é", "e", False), ("x²", "x2", False), ("①", "1", False), ("ı", "i", False), ("ł", "l", False), ("æ", "ae", False), ("a  b", "a b", False), ("a ", "a", False), ("a.", "a", False), ("ß", "ss", False), ("к", "k", False), ("👨‍👩", "👨👩", False), ("a\tb", "a b", False),
    ],
)
def test_lookalike_pairs(a, b, same):
    apply = lookalike.transducer().apply
    assert (apply(a) == apply(b)) is same
    assert apply(apply(a)) == apply(a)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_transducer_is_idempotent(text):
    apply = lookalike.transducer().apply
    assert apply(apply(text)) == apply(text)
    if text.isascii():
        assert apply(text) == text


def test_mapping_is_conflict_free_and_pairs(spark):
    mapping = lookalike.compile_mapping()
    assert not any(c in mapping for v in mapping.values() for c in v)
    rows = [(1, "ab", "a​b"), (1, "ab", "a​b"), (2, None, "x"), (3, "", "​"), (4, "A", "a"), (5, "é" * 10_000, "é" * 10_000)]
    df = spark.createDataFrame(rows, "pair_id int, a string, b string").withColumn("a_form", F.lit("clash"))
    assert sorted(r.pair_id for r in lookalike.lookalikes(df, ["pair_id"], "a", "b").collect()) == [1, 3, 5]
    assert lookalike.same_form(df, ["a"]).where("pair_id = 1").first().a_form == "ab"
    assert lookalike.lookalikes(df.limit(0), ["pair_id"], "a", "b").count() == 0


# 5: names


@pytest.mark.parametrize(
    "name,want",
    [
        ("Orvelthas Academy of Sciences", ("academy", "sciences", "orvelthas")), ("ORVELTHAS ACAD. SCI.", ("academy", "sciences", "orvelthas")), ("Orvelthas AS", ("academy", "sciences", "orvelthas")), ("Academy of Sciences, Orvelthas", ("academy", "sciences", "orvelthas")),
        ("Orvelthas University, Department of Physics", ("university", "", "orvelthas")), ("Unit 4, Université de Orvelthas (Thalor)", ("university", "", "orvelthas")), ("U. of Orvelthas", ("university", "", "orvelthas")),
        ("OrvelthasTech", ("institute", "technology", "orvelthas")), ("Orvelthas IT", ("institute", "technology", "orvelthas")), ("Marine Biology Hosp. of Orvelthas", ("hospital", "biology marine", "orvelthas")), ("Orvelthas PHRC", ("centre", "health public", "orvelthas")),
        ("Orvelthas Ctr forr Public Helath Rsch", ("centre", "health public", "orvelthas")), ("Klinikum Orvelthas", ("hospital", "", "orvelthas")), ("Orvelthas Polytechnic, Bad Mirna", ("polytechnic", "", "orvelthas")),
    ],
)
def test_read_name(name, want):
    assert names.read_name(name)[:3] == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abcz", min_size=1, max_size=9), min_size=1, max_size=25), st.integers(0, 4))
def test_radius_join_is_brute_force(texts, radius):
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    p = names.Points(texts)
    r, c, d = p.within(np.arange(len(texts)), p, radius)
    assert {(int(i), int(j)): int(k) for i, j, k in zip(r, c, d)} == {(i, j): lev(a, b) for i, a in enumerate(texts) for j, b in enumerate(texts) if lev(a, b) <= radius}


def test_name_classes(spark, monkeypatch):
    base = [(1, "Orvelthas University", "11111", "Mirna"), (2, "University of Orvelthas", "11111", "Mirna"), (3, "Orvelhtas Univ.", None, "Mirna"), (4, "Orvelthas General Hospital", "22222", "Mirna"), (5, "Orvelthas Hospital", "22222", None), (6, "Quembarrid University", "33333", "Sela"), (7, None, None, None), (8, "  ", None, None), (2, "University of Orvelthas", "11111", "Mirna"), (9, "Orvelthas University", "11111", "Mirna")]
    df = spark.createDataFrame(base, "mention_id bigint, name string, zip string, city string").withColumn("class", F.lit(0))
    want = {(1, 2), (1, 3), (2, 3), (2, 9), (3, 9), (4, 5)}
    for pivots, cell in ((names.PIVOTS, names.CELL), (1, 1)):  # one pivot a level: many levels, the same links
        monkeypatch.setattr(names, "PIVOTS", pivots)
        monkeypatch.setattr(names, "CELL", cell)
        monkeypatch.setattr(names, "BLOCK", 2)
        got = {(r.mention_a, r.mention_b) for r in names.class_pairs(names.mention_classes(df)).collect()}
        assert got == want
    assert names.class_pairs(names.mention_classes(df.limit(0))).count() == 0


def test_missing_places_and_kinds(spark):
    rows = [
        (1, "Drelquaetojeth General Hospital", "24349", "Bren"), (2, "Drlquaetoeth General Hospital", None, None),  # two edits, no place, no rival
        (3, "Klagusaeltros University", "26604", "Leisuli"), (4, "Klagusaelrtos University", None, None),  # a swap
        (5, "Quembarrid University", "33333", "Sela"), (6, "Quembarrid", "33333", None), (7, "Quembarrid Hospital", "44444", "Sela"),  # no kind told
        (8, "Stolgrindax University", "55555", "Mirna"), (9, "Stolgrendix University", "66666", "Mirna"), (10, "Stolgrindix University", None, "Mirna"), (11, "Stolgrandax University", None, None),  # rivals
    ]
    df = spark.createDataFrame(rows, "mention_id bigint, name string, zip string, city string")
    got = {(r.mention_a, r.mention_b) for r in names.class_pairs(names.mention_classes(df)).collect()}
    assert {(1, 2), (3, 4), (5, 6)} <= got and not got & {(5, 7), (6, 7), (8, 9)}
    # Between equally near rivals one is chosen, never both.
    assert len(got & {(8, 10), (9, 10)}) == 1 and got - {(8, 11), (8, 10), (10, 11), (9, 10)} == {(1, 2), (3, 4), (5, 6)}


def test_cells_lose_no_link(spark, monkeypatch):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randint(4, 12))) for _ in range(25)]

    def typo(x):
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(x))
            x = rng.choice([x[:i] + x[i + 1 :], x[:i] + rng.choice("aeioz") + x[i:], x[:i] + rng.choice("aeioz") + x[i + 1 :]])
        return x or "x"

    rows = []
    for i in range(400):
        k = rng.randrange(len(base)) if i % 3 else 0  # one holds a third of all
        rows.append((i, f"{typo(base[k])} University", rng.choice([f"{10000 + k}", f"{10000 + k}", None]), rng.choice([typo(base[k % 4] + "ville"), None])))
    df = spark.createDataFrame(rows, "mention_id bigint, name string, zip string, city string")
    results = []
    for pivots, cell in ((names.PIVOTS, 10_000), (40, 8)):
        monkeypatch.setattr(names, "PIVOTS", pivots)
        monkeypatch.setattr(names, "CELL", cell)
        groups = {}
        for r in names.mention_classes(df).collect():
            groups.setdefault(r["class"], set()).add(r.mention_id)
        results.append({frozenset(g) for g in groups.values()})
    assert results[0] == results[1] and max(map(len, results[0])) > 60


@settings(max_examples=300, deadline=None)
@given(st.text("abcz", max_size=14), st.lists(st.tuples(st.integers(0, 14), st.sampled_from(["", "a", "bz"])), max_size=3), st.booleans(), st.booleans())
def test_variants_share_a_piece(a, changes, cut_a, cut_b):
    b = a
    for i, x in changes:
        b = b[:i] + x + b[i + 1 :]
    d, short = names.levenshtein(a, b), min(len(a), len(b))
    prefix = d <= names.RADIUS and short >= 5 and (cut_a and len(a) <= len(b) and b.startswith(a) or cut_b and len(b) <= len(a) and a.startswith(b))
    if d <= names.reach(len(a), len(b)) or prefix:
        assert names._marks(a, cut_a, True) & names._marks(b, cut_b, False)


def test_names_of_a_city_take_no_more_jobs(spark, monkeypatch):
    monkeypatch.setattr(names, "CELL", 8)
    monkeypatch.setattr(names, "PIVOTS", 8)
    rng, track = random.Random(5), spark.sparkContext.statusTracker()
    cores = ["".join(rng.choice("bdglmrst") + rng.choice("aeiou") for _ in range(6)) for _ in range(48)]
    jobs = []
    for n in (4, 48):
        rows = [(k * 1000 + i, f"{cores[i]} {word}", None, "Mirna") for i in range(n) for k, word in enumerate(("University", "Univ."))]
        df = spark.createDataFrame(rows, "mention_id bigint, name string, zip string, city string")
        spark.sparkContext.setJobGroup(f"{n} names", "")
        try:
            assert {(i, 1000 + i) for i in range(n)} <= {(r.mention_a, r.mention_b) for r in names.class_pairs(names.mention_classes(df)).collect()}
            jobs.append(len(track.getJobIdsForGroup(f"{n} names")))
        finally:
            spark.sparkContext._jsc.clearJobGroup()
    assert jobs[1] <= jobs[0] + 8, jobs


# 6: percentiles


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50), min_size=1, max_size=300), min_size=1, max_size=8), st.sampled_from([0.01, 0.05, 0.2]))
def test_summaries_keep_their_bound(parts, eps):
    merged = None
    for p in parts:
        s = quantiles.compress(quantiles.exact(np.sort(np.array(p, dtype=float))), eps / 2 * len(p))
        merged = s if merged is None else quantiles.merge(merged, s)
    merged = quantiles.compress(merged, eps * merged.n)
    every = np.sort(np.concatenate([np.array(p, dtype=float) for p in parts]))
    assert merged.n == len(every) and quantiles.rank_error(merged) <= max(0.5, eps * merged.n) + 1e-9
    for p in (0.0, 0.25, 0.5, 0.99, 1.0):
        target = min(len(every), max(1, int(np.ceil(p * len(every) - 1e-9))))
        v = quantiles.query(merged, p)
        low, high = np.searchsorted(every, v, "left") + 1, np.searchsorted(every, v, "right")
        off = 0 if low <= target <= high else min(abs(target - low), abs(target - high))
        assert off <= quantiles.rank_error(merged) + 1e-9


def test_percentiles_of_days_and_models(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "CHUNK_ROWS", 3)
    nan = float("nan")
    rows = [(i, "m", f"2025-01-0{1 + i % 2} 10:00:00", float(i), None) for i in range(1, 10)] + [(1, "m", "2025-01-02 10:00:00", 1.0, None), (20, "m", None, -1.0, nan), (21, None, None, nan, 5.0)]
    df = spark.createDataFrame(rows, "prediction_id bigint, model string, t string, response_time double, llm_cost double").withColumn("completed_at", F.to_timestamp("t"))
    got = quantiles.day_and_model_percentiles(df, ["response_time", "llm_cost"], {"response_time": -1.0}, (0.5,)).collect()
    by = {(r.level, r.model, str(r.day), r.measure): (r.value, r.n) for r in got}
    assert by["model", "m", "None", "response_time"] == (5.0, 9)
    assert by["day", "m", "2025-01-01", "response_time"] == (4.0, 4) and by["model", None, "None", "llm_cost"] == (5.0, 1)
    assert ("model", "m", "None", "llm_cost") not in by
    assert quantiles.day_and_model_percentiles(df.limit(0), ["llm_cost"], {}).count() == 0


def test_default_bound_is_well_below_the_tail():
    n = 6000
    s = quantiles.compress(quantiles.exact(np.arange(1, n + 1, dtype=float)), quantiles.EPS * n)
    assert abs(quantiles.query(s, 0.99) - 5940) <= 0.1 * (1 - 0.99) * n + 1e-6


# 7: tokenizer


@needs_vocabulary
def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(VOCABULARY)
    theirs.encode_special_tokens = True
    ours = tokenizer.tokenizer()
    rng = random.Random(7)
    texts = ["", " ", "Hello  world", "<|endoftext|>", "a" * 3000, "é漢\U0001f468‍\U0001f469", "it's 12,345\n\n\tx"] + ["".join(rng.choice("aeiou thnrs019'\n\té漢😀-_") for _ in range(rng.randint(1, 50))) for _ in range(3000)]
    for t in texts:
        assert ours.encode(t) == theirs.encode(t, add_special_tokens=False).ids
        assert ours.decode(ours.encode(t)) == t
    assert ours.encode(None) == []


@needs_vocabulary
def test_encode_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Hello"), (3, "Hello"), (None, "x")], "doc_id bigint, text string").withColumn("ids", F.lit(1)).withColumn("key", F.lit(2))
    got = [(r.doc_id, r.ids) for r in tokenizer.encode_texts(df).collect()]
    assert len(got) == 5 and (1, []) in got and (2, []) in got and (3, [15496]) in got
    assert tokenizer.encode_texts(df.limit(0)).count() == 0
    back = spark.createDataFrame([(1, [15496]), (2, []), (3, None)], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in tokenizer.decode_ids(back).collect()} == {1: "Hello", 2: "", 3: None}


# 8: packing


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(0, 50)), min_size=1, max_size=120), st.integers(1, 9))
def test_fill_respects_all_limits(items, segments):
    demand = np.array([(t, 1, min(l, t)) for t, l in items])
    limits = np.array([50, segments, 40])
    demand[:, 2] = np.minimum(demand[:, 2], 40)
    bins = packing.fill(demand, limits)
    totals = np.zeros((bins.max() + 1, 3), dtype=int)
    np.add.at(totals, bins, demand)
    assert (totals <= limits).all() and (totals[:, 1] > 0).all()


def test_pack(spark):
    sizes = spark.createDataFrame([(1, 100, 99), (2, 250, 10), (3, 0, 0), (4, None, None), (5, 28, 0)] + [(i, 60, 5) for i in range(10, 20)], "doc_id bigint, tokens bigint, loss bigint")
    windows = spark.createDataFrame([(1, 128), (1, 128), (2, 1024)], "window_id int, capacity_tokens int")
    out = packing.pack(sizes, windows)
    rows = out.collect()
    for w, cap in ((1, 128), (2, 1024)):
        mine = [r for r in rows if r.window_id == w]
        load = {}
        for r in mine:
            if r.bin_id is not None:
                load[r.bin_id] = load.get(r.bin_id, 0) + r.n_tokens
        assert max(load.values()) <= cap and sum(load.values()) == 100 + 250 + 28 + 600
        assert {r.doc_id for r in mine if r.bin_id is None} == {3, 4}
        cut = sorted((r.start_token, r.n_tokens) for r in mine if r.doc_id == 2)
        assert cut == ([(0, 128), (128, 122)] if cap == 128 else [(0, 250)])
    assert packing.fill_report(out, windows).count() == 2
    assert packing.pack(sizes.limit(0), windows).count() == 0 and packing.pack(sizes, windows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(sizes, spark.createDataFrame([(1, 0)], "window_id int, capacity_tokens int"))


def test_pack_limits_bind(spark, monkeypatch):
    monkeypatch.setattr(packing, "PASS_WINDOWS", 1)
    sizes = spark.createDataFrame([(i, 10, i % 5) for i in range(50)] + [(99, 10, 300)], "doc_id bigint, tokens bigint, loss bigint")
    windows = spark.createDataFrame([(1, 100, 3, None), (2, 100, None, 7), (3, 100, 3, 7)], "window_id int, capacity_tokens int, capacity_segments int, capacity_loss int")
    loss = {i: i % 5 for i in range(50)} | {99: 7}
    load = {}
    for r in packing.pack(sizes, windows).collect():
        load.setdefault((r.window_id, r.bin_id), []).append(r.doc_id)
    for (w, _), docs in load.items():
        assert len(docs) <= (3 if w != 2 else 10) and (w == 1 or sum(loss[i] for i in docs) <= 7)
    assert sorted(i for (w, _), docs in load.items() if w == 3 for i in docs) == [*range(50), 99]


@needs_vocabulary
def test_instruction_sizes(spark):
    docs = spark.createDataFrame([(1, "Hello"), (2, None), (3, "Hello world")], "doc_id bigint, text string")
    answers = spark.createDataFrame([(1, "Hello"), (1, "x"), (2, None)], "doc_id bigint, answer string")
    assert sorted(tuple(r) for r in packing.instruction_sizes(docs, answers).collect()) == [(1, 2, 1), (1, 2, 1), (2, 0, 0), (3, 2, 0)]


# 9: residue


@pytest.mark.parametrize(
    "text,want",
    [
        ("Dear {{ first_name | upper }}, hello", True), ("Hi [Your Name]!", True), ("Price: $PRICE$", True), ("Dear @@author_name@@, thank you.", True), ("Bonjour (insert city here), merci.", True), ("Welcome to &lt;first_name&gt;, friend.", True), ("Dear %s, hello", True), ("Dear @name@, hello", True), ("Write to me@home.org (your call).", False), ("In Mustache you write {{name}} and it is replaced.", False), ("Template engines replace {{ title }} with text; this tutorial shows how.", False), ("Use `{{city}}` as a marker.\nThen {{city}} is shown.", False), ("Use `{{city}}` as a marker.\nDear {{name}}, hello.", True), ("Hello <Your City>.", True), ("{% order_id %}", True), ("*|EMAIL|*", True), ("[INSERT DATE HERE]", True), ("It costs %PRICE% now", True), ("See «Author Name»", True), ("Contact {0} now", True), ("__TITLE__", True), ("[hier Datum einfügen] [hier City einfügen]", True),
        ("Use `{{name}}` as the marker.", False), ("```\n{{ name }}\n```\nThat renders the page.", False), ('The marker "{{name}}" stands for the recipient.', False), ("It is so [sic] and [12].", False), ("{a, b} and f(x) = {x | x > 2}", False), ("100% of 42% is fun", False), ("__init__ files", False), ("<b>bold</b> kettle", False), ("<title>Fine kettles of the north</title>", False),
        ("Lorem ipsum dolor sit amet, consectetur adipiscing elit.", True), ("404 Not Found", True), ("Menu\n\nError 66: page not available\n(c) 2025", True), ("Please enable JavaScrpt to view this page.", True), ("foo bar baz foo bar", True), ("Traceback (most recent call last):\n  File \"a.py\", line 3, in load\nTimeoutError: read timed out", True), ('{"error": {"code": 429, "message": "rate limit reached"}}', True), ("Seite nicht gefunden.", True), ("Página no encontrada", True), ("ページが見つかりません。", True), ("找不到页面", True), ("请启用JavaScript以继续。", True), ("페이지를 찾을 수 없습니다.", True), ("編集者は何も言わずに例を読み返した。 ページが見つかりません。", False), ("ERR_CONNECTION_TIMED_OUT", True), ("<h1>400 bad request</h1><hr>wb/68", True), ("Tеxte de remplissage, à compléter.", True),
        ("The review says the shop answered with a 404 page for 3 days, but the kettle is good.", False), ("Lorem ipsum dolor sit amet. The kettle leaks badly and my dog hates it.", False), ("It is fine.", False), ("Never again.", False), ("", False), (" \n", False), (None, False), ("Good kettle. " * 20_000, False),
    ],
)
def test_residue_cases(text, want):
    assert residue.is_residue(text) is want


def test_residue_tables(spark):
    df = spark.createDataFrame([(1, "404 Not Found"), (1, "404 Not Found"), (2, "A good kettle."), (3, None), (4, "")], "doc_id bigint, text string").withColumn("residue", F.lit("x")).withColumn("key", F.lit(0))
    assert [r.doc_id for r in residue.residue_ids(df).collect()] == [1]
    assert sorted(r.doc_id for r in residue.clean_corpus(df).collect()) == [2, 3, 4] and residue.clean_corpus(df).columns == df.columns
    assert sum(r.residue for r in residue.flag_residue(df).collect()) == 2
    assert residue.residue_ids(df.limit(0)).count() == 0


def test_every_llm_query_runs(spark, sf):
    from tallymark.llm import queries

    for name, q in queries.QUERIES.items():
        df = q(spark, sf)
        assert len(set(df.columns)) == len(df.columns), name
        df.write.format("noop").mode("overwrite").save()


def test_found_columns(spark, sf):
    from tallymark.llm import queries

    want = {"p1_found": {"record_kind": "string", "record_id": "bigint", "canon_id": "bigint"}, "p3_found": {"record_kind": "string", "record_id": "bigint"}, "p5_found": {"mention_a": "bigint", "mention_b": "bigint"}, "p7_ids": {"doc_id": "bigint", "ids": "array<int>"}, "p9_found": {"doc_id": "bigint"}}
    for name, columns in want.items():
        assert dict(queries.QUERIES[name](spark, sf).dtypes) == columns
