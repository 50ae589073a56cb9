"""Operators for training data against brute force, exact round trips and held-out accuracy."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crucible.llm import garbled, grouped_split, packing, similar_sets, split_overlap, term_counts, tokens


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


# --- 1 ---------------------------------------------------------------------


def test_close_texts_is_exact(spark):
    rng = random.Random(3)
    texts = {"".join(rng.choice("ab") for _ in range(n)) for n in (1, 2, 3, 4, 5, 9, 14) for _ in range(14)}
    rows = [(i, t) for i, t in enumerate(sorted(texts))]
    df = spark.createDataFrame(rows, "tid long, text string")
    got = {(r.e, r.t) for r in split_overlap.close_texts(df, df, 2).collect()}
    assert got == {(i, j) for i, a in rows for j, b in rows if distance(a, b) <= 2}


def test_split_overlaps(spark):
    rows = [
        (1, "CCO", " Train", "s"), (2, "OCC", "test", "s"), (3, "CCO", "valid", None), (4, "CCCCCCCCN", "train", "s"), (5, "CCCCCCCC=N", "TEST", "s"), (6, None, "test", "s"), (7, " ", "train", "s"), (8, "xyz(", "train", "s"), (9, "xyz(", "test", "s"),
        (10, "CCO", None, "s"), (11, "CCO.Cl", "other", "s"), (12, "C1CCCCCCCCC1", "test", "t"),
    ]
    df = spark.createDataFrame(rows, "record_id long, smiles string, split string, source string").withColumn("text", F.lit("clash")).withColumn("id", F.lit(0))
    got = {(r.train_id, r.eval_id, r.reason) for r in split_overlap.split_overlaps(df).collect()}
    assert got == {(1, 2, "molecule"), (1, 3, "molecule"), (4, 5, "edit"), (8, 9, "edit")}
    rep = {(r.split, r.source): (r.records, r.overlapping, r.pairs) for r in split_overlap.overlap_report(df).collect()}
    assert rep[("test", "s")] == (4, 3, 3) and rep[("valid", None)] == (1, 1, 1) and rep[("test", "t")] == (1, 0, 0)
    assert split_overlap.split_overlaps(df.limit(0)).count() == 0


# --- 3 ---------------------------------------------------------------------


@pytest.mark.parametrize("flush", [200_000, 2])
def test_term_frequencies(spark, monkeypatch, flush):
    monkeypatch.setattr(term_counts, "FLUSH", flush)
    df = spark.createDataFrame([("CCl[NH3+]%12",), ("C C\t",), (None,), ("",), ("CBr",), ("C[",)], "smiles string").withColumn("term", F.lit("clash"))
    got = {r.term: (r.occurrences, r.records, r.mark) for r in term_counts.term_frequencies(df, "smiles", min_records=2, max_share=0.6).collect()}
    assert got == {"C": (5, 4, "common"), "Cl": (1, 1, "rare"), "[NH3+]": (1, 1, "rare"), "%12": (1, 1, "rare"), "Br": (1, 1, "rare"), "[": (1, 1, "rare")}
    assert term_counts.term_frequencies(df.limit(0), "smiles").count() == 0


def test_many_ranges_of_terms(spark, monkeypatch):
    monkeypatch.setattr(term_counts, "RANGE", 7)
    rng = random.Random(8)
    texts = [" ".join(f"w{min(rng.randrange(300), rng.randrange(300))}" for _ in range(20)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(5)
    got = {r.term: (r.occurrences, r.records) for r in term_counts.term_frequencies(df, "t", r"\S+").collect()}
    words = {w for t in texts for w in t.split()}
    assert got == {w: (sum(t.split().count(w) for t in texts), sum(w in t.split() for t in texts)) for w in words}


# --- 4 ---------------------------------------------------------------------


def test_groups_and_split(spark):
    rng = random.Random(1)
    rows = [(i, f"{'C' * (3 + i % 400)}O" if i % 7 else None, f"d{rng.randrange(300)}" if i % 5 else None, ("train", "Valid ", "test", None)[i % 4], ("a", "b", None)[i % 3]) for i in range(1200)]
    rows += [(5000 + i, None, "hub", "train", "a") for i in range(400)]
    df = spark.createDataFrame(rows, "record_id long, smiles string, doc_ref string, split string, source string").withColumn("component", F.lit("clash"))
    root = {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for col in (1, 2):
        first = {}
        for r in rows:
            if r[col] is not None:
                root[find(r[0])] = find(first.setdefault(r[col], r[0]))
    want = {}
    for r in rows:
        want.setdefault(find(r[0]), set()).add(r[0])
    got = {}
    for r in grouped_split.related_groups(df).collect():
        got.setdefault(r.component, set()).add(r.id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    bad = {r.record_id for r in grouped_split.leaking_records(df).collect()}
    split = {r[0]: r[3] and r[3].strip().lower() for r in rows}
    assert bad == {i for g in want.values() for i in g if split[i] and len({split[j] for j in g if split[j]}) > 1}
    out = grouped_split.grouped_split(df).collect()
    assert len(out) == len(rows) and all(len({r.new_split for r in out if r.component == c}) == 1 for c in got)
    assert grouped_split.grouped_split(df.limit(0)).count() == 0


def test_annealing_meets_the_shares():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 30, 400).astype(float)
    labels = np.eye(4)[rng.integers(0, 4, 400)] * sizes[:, None]
    share = np.array([0.8, 0.1, 0.1])
    start = grouped_split._hashed(np.arange(400), share)
    where, cost = grouped_split.anneal(sizes, labels, share * sizes.sum(), share[:, None] * labels.sum(axis=0), start, 20_000, 1)
    got = np.array([sizes[where == k].sum() for k in range(3)]) / sizes.sum()
    assert np.abs(got - share).max() < 0.003 and cost < 1e-4
    lab = np.array([labels[where == k].sum(axis=0) for k in range(3)]) / sizes.sum()
    want = share[:, None] * labels.sum(axis=0) / sizes.sum()
    assert abs(cost - ((got - share) ** 2).sum() - 0.5 * ((lab - want) ** 2).sum()) < 1e-9


# --- 5 ---------------------------------------------------------------------


def test_similar_records(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("CNOcn()=1") for _ in range(70)) for _ in range(60)]
    texts = base + [b[:k] + "X" + b[k + 1 :] for b in base for k in (5, 35)] + [b[: 70 - k] for b in base for k in (8, 15, 20)] + base[:10]
    rows = [(1000 + i, f" {t}\t" if i % 3 else t) for i, t in enumerate(texts)] + [(1, None), (2, ""), (3, "CCCCC"), (4, "CCCCCC"), (5, "CCCCCCC"), (6, "N" * 9000)]
    df = spark.createDataFrame(rows, "id long, smiles string").withColumn("tid", F.lit("clash"))
    sets = {i: {t.strip()[k : k + 6] for k in range(len(t.strip()) - 5)} for i, t in rows if t}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    got = [(r.id_a, r.id_b) for r in similar_sets.similar_records(df, "id", "smiles").collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.99 * len(want) and (4, 5) in got
    assert similar_sets.similar_records(df.limit(0), "id", "smiles").count() == 0


def test_bitmaps_differ_at_most_as_the_sets_do():
    rng = random.Random(4)
    texts = ["".join(rng.choice("CNO(") for _ in range(n)) for n in (6, 6, 7, 9, 20, 80, 80, 400) for _ in range(6)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["tid", "text"])
    rows = next(similar_sets._sketches(6, 3, 40, 20)(iter([batch]))).to_pylist()
    assert [r["size"] for r in rows] == [len({t[k : k + 6] for k in range(len(t) - 5)}) for t in texts]
    sets = [{t[k : k + 6] for k in range(len(t) - 5)} for t in texts]
    for a, b in itertools.combinations(range(len(texts)), 2):
        differ = sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(rows[a]["bits"], rows[b]["bits"], strict=True))
        assert differ <= len(sets[a] ^ sets[b]), (texts[a], texts[b])


@pytest.mark.parametrize("hot", [2048, 5])
def test_neighbours_in_a_tree(spark, monkeypatch, hot):
    monkeypatch.setattr(similar_sets, "HOT", hot)
    rng = random.Random(9)
    rows = [(rng.choice([1, 1, 2, 3, rng.randrange(10, 90)]), rng.randrange(4) << 20 | rng.randrange(2) << 10 | rng.randrange(2), i % 120, 50 + rng.randrange(40)) for i in range(240)]
    df = spark.createDataFrame(rows, "head long, tail int, tid long, size int")
    want = {}
    for (h, t, i, m), (g, u, j, n) in itertools.combinations(rows, 2):
        if h == g and i != j and min(m, n) >= max(m, n) * 0.7 - 1:
            x = t ^ u
            deeper = 0 if x >> 20 else 1 if x >> 10 else 2 if x else 3
            key = (min(i, j), max(i, j))
            want[key] = max(want.get(key, 0), deeper)
    assert {(r.x, r.y): r.deeper for r in similar_sets.candidates(df, 0.7).collect()} == want
    assert similar_sets.candidates(df.limit(0), 0.7).count() == 0


def test_forest_shares_prefixes_as_often_as_it_says():
    rng = random.Random(11)
    base = "".join(rng.choice("CNOcn()=1") for _ in range(120))
    texts = [base] + [base[: 120 - k] + "".join(rng.choice("FSPB") for _ in range(k)) for k in range(4, 44, 2) for _ in range(10)]
    sets = [{t[k : k + 6] for k in range(len(t) - 5)} for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["tid", "text"])
    rows = next(similar_sets._sketches(6, 3, 200, 20)(iter([batch]))).to_pylist()
    for k in range(1, len(texts), 10):
        shared = np.mean([rows[0]["heads"][t] == rows[i]["heads"][t] for i in range(k, k + 10) for t in range(200)])
        want = np.mean([(len(sets[0] & sets[i]) / len(sets[0] | sets[i])) ** 3 for i in range(k, k + 10)])
        assert abs(shared - want) < 0.07, (k, shared, want)


# --- 6, 7 ------------------------------------------------------------------

TEXTS = ["", None, " ", "Hello world's <|endoftext|> 12345", "naïve café – 東京 😀​\x85", "a" * 3000, "don't  \n\n x", "été é", "The the THE " * 400, "\x00\x01"]


def test_encoding_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in tokens.encode_texts(df, "doc_id", "text").collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
    n = {r.doc_id: r.tokens for r in tokens.encode_texts(df, "doc_id", "text", out="tokens").collect()}
    assert n == {i: len(v) for i, v in got.items()}
    assert tokens.encode_texts(df.limit(0), "doc_id", "text").count() == 0


def test_packing(spark):
    rng = random.Random(2)
    sizes = {i: rng.choice([1, 3, 40, 99, 100, 101, 250, 512, 700, 1024, 1999, 2048, 2049, 5000]) for i in range(900)} | {9000 + i: 100 for i in range(500)} | {9990: 0}
    df = spark.createDataFrame([*sizes.items(), (9999, None)], "doc_id long, tokens long").withColumn("piece", F.lit("clash"))
    out = packing.pack(df).collect()
    load, of = {}, {}
    for r in out:
        load[r.container] = load.get(r.container, 0) + r.tokens
        of.setdefault(r.doc_id, []).append((r.piece, r.tokens))
    assert max(load.values()) <= 2048 and set(of) == {i for i, n in sizes.items() if n}
    for i, p in of.items():
        assert [k for k, _ in sorted(p)] == list(range(len(p))) and sum(t for _, t in p) == sizes[i] and (sizes[i] > 2048 or len(p) == 1)
    total = sum(sizes.values())
    assert len(load) <= 1.01 * total / 2048 + 1 and sorted(load) == list(range(len(load)))
    assert packing.pack(df.limit(0)).count() == 0


def test_index_of_sums_is_exact():
    rng = random.Random(6)
    for _ in range(60):
        have = np.zeros(41, np.int64)
        for _ in range(rng.randrange(1, 9)):
            have[rng.randrange(1, 41)] += rng.randrange(1, 3)
        index = packing.SumIndex(have)
        for _ in range(int(have.sum()) // 2):
            items = [s for s in range(41) for _ in range(int(index.singles[s]))]
            for gap in range(1, 41):
                got = index.exact(gap)
                there = any(sum(c) == gap for k in (1, 2, 3) for c in itertools.combinations(items, k))
                assert bool(got) == there and (not got or (sum(got) == gap and all(items.count(s) >= got.count(s) for s in got)))
            index.take(rng.choice(items))


# --- 8 ---------------------------------------------------------------------

WORDS = "für Größe Ähnlichkeit geprüft Löslichkeit über élève clé référence déjà façon año señal más débil código ação relação máxima posição Выход составил температура плавления дескриптор удалён разделена °C µM β-strand – “x” ± Å R²".split()


@pytest.fixture(scope="module")
def model():
    rng = random.Random(0)
    plain = "the assay was run with and of to at compound".split()
    texts = [" ".join(rng.choice(WORDS) if rng.random() < 0.4 else rng.choice(plain) for _ in range(60)) for _ in range(300)]
    texts = [t + " √35 ≈ 2 and ¬(x) »y« ¶" * (i % 50 == 0) for i, t in enumerate(texts)]  # signs that are meant
    return garbled.train(garbled.token_counts(texts), len(texts))


def test_restores_each_chain(model):
    judge = garbled.Judge(model)
    text = "Größe geprüft: élève clé, año señal máxima relação"
    for chain in garbled.CHAINS:
        if chain[-1][0] != "utf-8" or chain[0][0] != "utf-8":
            continue
        bad = garbled.garble(text, chain)
        assert garbled.invert(bad, chain) == text
        words = [w for w in garbled.TOKEN.findall(bad)]
        back = [judge(w)[1] for w in words]
        assert sum(garbled.TOKEN.fullmatch(b) is not None and b in text.replace(":", " ").replace(",", " ").split() or b.strip(":,") in text for b in back) >= 0.8 * len(words), chain
    for chain in ((("cp1252", "mac_roman"),), (("cp1251", "cp1252"),), (("cp1251", "koi8-r"),)):
        source = "geprüft Löslichkeit référence" if chain[0][0] == "cp1252" else "температура плавления разделена"
        bad = garbled.garble(source, chain)
        assert [judge(w)[1] for w in garbled.TOKEN.findall(bad)] == source.split(), chain


def test_finds_rows(spark, model):
    utf = lambda s, c="cp1252": garbled.garble(s, (("utf-8", c),))
    rows = [(1, "Größe geprüft"), (2, "plain"), (3, None), (4, ""), (5, utf("Größe") + " geprüft"), (6, "Gr��e"), (7, "√35 ≈ 2 and ¬(x) »y« ¶"), (8, "Größe " * 3000 + utf("élève", "mac_roman")), (9, "東京 😀 é"), (10, utf(utf("señal")))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chains", F.lit("clash")).withColumn("id", F.lit(1))
    got = {r.doc_id: r for r in garbled.garbled_texts(df, model=model).collect()}
    assert set(got) == {5, 6, 8, 10} and got[5].restored == "Größe geprüft" and got[6].lost and got[8].restored.endswith(" élève") and got[10].restored == "señal"
    assert garbled.garbled_texts(df.limit(0), model=model).count() == 0


def test_verdicts_count_all_texts(spark, model):
    chain = (("cp1252", "mac_roman"),)
    bad, other = garbled.garble("Löslichkeit", chain), garbled.garble("Trübung", chain)
    lone, common = garbled.garble("Lösungsgeschwindigkeit", chain), "Lösungsgeschwindigkeit"
    rows = [(i, f"{i} the {bad} was") for i in range(400)]  # a word that many texts mean, though the fit didn't see it
    rows += [(1000 + i, f"x {common} {i} " + "of " * 9000 + f"{i} Trübung") for i in range(60)] + [(2000, f"the {lone} was")]
    rows += [(3000 + i, f"the same {other} text") for i in range(30)]  # copies of one text count once
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.restored for r in garbled.garbled_texts(df, model=model).collect()}
    assert got == {2000: f"the {common} was"} | {3000 + i: "the same Trübung text" for i in range(30)}


def test_fit_samples_distinct_texts(spark, monkeypatch):
    monkeypatch.setattr(garbled, "train", lambda counts, texts: (counts, texts))
    df = spark.createDataFrame([(f"é {i % 7}é",) for i in range(70)] + [("",), (None,), ("of " * 9000 + "Größe",)], "text string")
    counts, texts = garbled.fit_sample(df, "text", 20)
    assert texts == 8 and counts == {"é": 7, "0é": 7, "Größe": 1}  # whole texts, digits as one
    assert garbled.fit_sample(df, "text", 3)[1] == 3 and len(garbled.fit_sample(df, "text", 20, 2)[0]) == 2
    assert garbled.fit_sample(df.limit(0), "text") == ({}, 0)


def test_finds_places_deep_in_a_run_without_white_space(spark, model):
    bad, latin = (garbled.garble("температура_плавления", (("utf-8", "cp1252"),)), garbled.garble("Größe", (("utf-8", "cp1252"),)))
    rows = [(1, "ж" * 3000 + bad), (2, "ж" * 3000), (3, bad + "ж" * 3000), (4, "ж" * 700 + bad + "ж" * 700), (5, "é" * 5000 + bad * 9), (6, "ж" * 2000 + latin + "ж" * 99)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.restored for r in garbled.garbled_texts(df, model=model).collect()}
    assert {1, 3, 4, 5, 6} <= set(got) and 2 not in got and got[6] == "ж" * 2000 + "Größe" + "ж" * 99
    assert got[1].startswith("ж" * 3000) and "плавления" in got[1] and "плавления" in got[4]


@pytest.mark.parametrize("hot", [2048, 4])
def test_trees_grown_in_rounds_leave_no_signatures(spark, monkeypatch, hot):
    """Pairs are those of the exact sets, also from blocks of hot neighbourhoods, and what is kept on disk is little more than the texts."""
    from pathlib import Path

    from crucible.runtime import tables_of

    monkeypatch.setattr(similar_sets, "HOT", hot)
    monkeypatch.setattr(similar_sets, "LEAVES", 2_000)
    rng = random.Random(12)
    base = ["".join(rng.choice("CNOcn()=1") for _ in range(100)) for _ in range(300)]
    texts = base + [b[:50] + "X" + b[51:] for b in base[:40]] + [base[0][:k] + "Y" + base[0][k + 1 :] for k in range(90, 100)] + base[:5]
    rows = list(enumerate(texts))
    sets = [{t[k : k + 6] for k in range(len(t) - 5)} for t in texts]
    want = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    before = tables_of(spark)
    got = [(r.id_a, r.id_b) for r in similar_sets.similar_records(spark.createDataFrame(rows, "id long, smiles string"), "id", "smiles").collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.99 * len(want)
    new = [p for p in tables_of(spark) if p not in before]
    assert len(new) == 2 and sum(f.stat().st_size for p in new for f in Path(p.removeprefix("file:")).rglob("*.parquet")) < 4 * sum(map(len, texts))
