"""Lexical search, phrase counting and token counts against brute force, SQL twins and awkward rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import compare
from conftest import SF_DIR
from recordmill.llm import collocations, lexical_search, token_counts
from recordmill.llm.fields import cut
from recordmill.llm.queries import ORACLE, PIECES, QUERIES

LONG = "a very long text, of many words. " * 4000
AWKWARD = [
    (1, "plain words in a row"), (None, "no id plain"), (2, None), (3, ""), (4, " \t\n"), (5, LONG), (6, "x" * 5000),
    (7, "same text\nsame text\nsame text"), (7, "same text\nsame text\nsame text"), (8, "nul \x00 and é漢字😀 \xa0 end"), (9, "Plain PLAIN ÉÀ ²½"),
]
CLASHING = ("UID", "Number", "term", "shard", "N_tokens", "weight", "start", "Text_", "lang")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


@pytest.fixture(scope="module")
def awkward(spark):
    rows = spark.createDataFrame(AWKWARD, "doc_id bigint, text string").repartition(3)
    return rows.withColumns({n: F.lit(n) for n in CLASHING})


@pytest.mark.parametrize("name", ["op11_lexical", "op12_collocations"])
def test_twin(spark, con, monkeypatch, name):
    monkeypatch.setattr(compare, "QUERIES", QUERIES)
    monkeypatch.setattr(compare, "ORACLE", ORACLE)
    assert compare.difference(spark, con, SF_DIR, name) is None


def test_cut_equals_a_pattern():
    pick = random.Random(4)
    texts = ["".join(pick.choices("aB é漢1 .\t\n-!", k=pick.randrange(12))) for _ in range(400)] + [None, "", "A"]
    for part in (texts, texts[5:90]):
        column = pa.array(texts)[5:90] if part is not texts else pa.array(texts)
        found = cut(column, lexical_search._KIND, lexical_search._FOLD)
        wanted = [(i, m.translate(str.maketrans("AB", "ab"))) for i, t in enumerate(part) for m in re.findall(TERM, t or "")]
        assert list(zip(found.row.tolist(), found.words.to_pylist())) == wanted
        pieces = cut(column, collocations._KIND, collocations._FOLD)
        counted: dict = {}
        for word, at in zip(pieces.words.to_pylist(), pieces.piece.tolist()):
            counted.setdefault(at, []).append(word)
        wanted = [p for t in part for p in phrase_pieces(t)]
        assert list(counted.values()) == wanted


# --- lexical search --------------------------------------------------------------------------

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(documents, query, k=10):
    """Every document scored, one after the other."""
    bags = [(i, Counter(re.findall(TERM, (t or "").translate(LOWER)))) for i, t in documents]
    bags = [(i, b) for i, b in bags if b]
    total, length = len(bags), sum(sum(b.values()) for _, b in bags)
    found = []
    for doc_id, bag in bags:
        m, score = 25 + 75 * sum(bag.values()) * total // length, 0
        for term, times in Counter(re.findall(TERM, (query or "").translate(LOWER))).items():
            if bag[term]:
                df = sum(term in b for _, b in bags)
                score += times * math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1))) * (10**9 * bag[term] // (1000 * bag[term] + 8 * m))
        if score > 0:
            found.append((doc_id, score))
    return sorted(found, key=lambda f: (-f[1], f[0] is None, f[0] or 0))[:k]


def found_by_query(rows):
    out: dict = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r["rank"] == len(out[r.item_id])
    return out


def test_variable_bytes():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**40, 5])
    data, ends = lexical_search.pack(values)
    assert lexical_search.unpack(data).tolist() == values.tolist() and ends[-1] == len(data)


def test_best_equals_scoring_everything(monkeypatch):
    """Small ranges, so that lists become passive, ranges are skipped and blocks stay packed."""
    pick, packed = np.random.default_rng(5), 0
    for trial in range(25):
        documents = int(pick.integers(400, 3000))
        texts = [" ".join(f"w{int(w)}" for w in pick.zipf(1.4, pick.integers(1, 30)) if w < 500) for _ in range(documents)]
        parts = [(lexical_search.terms(pa.array(texts)), pa.array(np.arange(documents)))]
        length = len(parts[0][0])
        rows = lexical_search._postings_of(0, parts, documents, length).to_pylist()
        head = next(r for r in rows if r["term"] is None)
        m = np.frombuffer(head["data"], "<i8")
        at = np.frombuffer(head["lasts"], "<i8")
        lists = {r["term"]: r for r in rows if r["term"] is not None}
        wanted = [(int(pick.integers(1, 9000)), str(t)) for t in pick.choice(sorted(lists), min(len(lists), 6), replace=False)]
        wanted += [(3, 'w1'), (9, 'w2')]
        exact = np.zeros(len(m), np.int64)
        opened = [(w, lexical_search.Postings(lists[t], m)) for w, t in wanted]
        for w, t in wanted:
            whole = lexical_search.Postings(lists[t], m)
            docs, impact = whole.between(0, len(m))
            assert len(docs) == lists[t]["df"]
            np.add.at(exact, docs, w * impact)
        scores, docs = lexical_search.best(opened, len(m), 10, span=128)
        order = np.lexsort((at, -exact))[:10]
        order = order[exact[order] > 0]
        assert docs.tolist() == order.tolist() and scores.tolist() == exact[order].tolist()
        packed += sum(not p.open.all() for _, p in opened)
    assert packed > 10


def test_search_awkward(spark, awkward, monkeypatch):
    monkeypatch.setattr(lexical_search, "QUERIES", 2)
    items = [(1, "plain Words"), (2, None), (3, ""), (4, "nowhere"), (5, "text same same É漢字"), (None, "row x"), (6, LONG), (1, "plain Words")]
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumns({n: F.lit(n) for n in CLASHING})
    index = lexical_search.build(awkward)
    found = found_by_query(lexical_search.search(index, asked).collect())
    assert found == {i: ranked(AWKWARD, t) for i, t in items if ranked(AWKWARD, t)}
    assert lexical_search.search(lexical_search.build(awkward.limit(0)), asked).count() == 0
    assert lexical_search.search(index, asked.limit(0)).count() == 0


def test_search_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "SHARD_DOCUMENTS", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    pick = random.Random(6)
    documents = [(i // 2, " ".join(pick.choices("a b c d e f g hh ii".split(), k=pick.randrange(1, 8)))) for i in range(300)]
    items = [(i, " ".join(pick.choices("a b c hh zz".split(), k=4))) for i in range(5)]
    try:
        index = lexical_search.build(spark.createDataFrame(documents, "doc_id bigint, text string").repartition(3))
        assert index.postings.select("shard").distinct().count() > 10
        found = found_by_query(lexical_search.search(index, spark.createDataFrame(items, "item_id bigint, text string")).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    assert found == {i: ranked(documents, t) for i, t in items}


# --- collocations ----------------------------------------------------------------------------

def phrase_pieces(text):
    pieces = (re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)))
    return [p for p in pieces if p]


def phrase_counts(rows, least, longest=4):
    counts: Counter = Counter()
    for lang, text in rows:
        for words in phrase_pieces(text):
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang or "und", tuple(words[i : i + k])] += 1
    return {key: n for key, n in counts.items() if n >= least}


def scored(rows, least, kept):
    f = phrase_counts(rows, least)
    totals: Counter = Counter()
    for lang, text in rows:
        totals[lang or "und"] += sum(map(len, phrase_pieces(text)))
    out: dict = {}
    for (lang, words), a in f.items():
        k = len(words)
        inside = [n for (other, longer), n in f.items() if other == lang and len(longer) > k and any(longer[i : i + k] == words for i in range(len(longer) - k + 1))]
        if k < 2 or any(100 * n >= 80 * a for n in inside):
            continue
        cuts = [(Fraction(2_000_000 * a, f[lang, words[:c]] + f[lang, words[c:]]).__floor__(), c, f[lang, words[:c]], f[lang, words[c:]]) for c in range(1, k)]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return {(lang, n + 1, p.decode(), -a, left, right, totals[lang], -s) for lang, found in out.items() for n, (s, a, p, left, right) in enumerate(sorted(found)[:kept])}


@pytest.mark.parametrize("shards,bits", [(1, 12), (2, 6), (4, 2)])
def test_collocations_equal_brute_force(spark, monkeypatch, shards, bits):
    """Many small blocks; tables so small that phrases share slots."""
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 200)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    pick = random.Random(shards)
    rows = [(pick.choice(["en", "de", None, "und", "x\ny"]), "".join(pick.choices(["a ", "b ", "c ", "D ", "d\t", "é ", "a b c ", "b c d a ", ". ", "\n"], k=pick.randrange(30)))) for _ in range(400)]
    rows += [("en", None), ("en", ""), (None, ".,;"), ("en", "a b c " * 800)]
    df = spark.createDataFrame([(lang, text, 1, "x") for lang, text in rows], "lang string, text string, phrase int, N string").repartition(7)
    try:
        stored = collocations.blocks(df, shards=shards)
        assert stored.select("shard").distinct().count() == shards
        counts = collocations.frequent(stored, 8, shards, 4, bits)
        found = {(r.lang, tuple(r.phrase.split(" "))): r.n for r in counts.collect()}
        assert found == phrase_counts(rows, 8)
        best = collocations.mine(df, least=8, kept=12, shards=shards, bits=bits)
        assert {tuple(r) for r in best.collect()} == scored(rows, 8, 12)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


def test_collocations_awkward(spark, awkward):
    found = collocations.mine(awkward).collect()
    assert {(r.lang, r.phrase) for r in found} == {(la, p) for la, _, p, *_ in scored([("lang", t) for _, t in AWKWARD], 30, 2000)}
    assert collocations.mine(awkward.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 4 * 10**18
    counts = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big), ("en", "a b", 2, big)], "lang string, phrase string, k int, n bigint")
    words = spark.createDataFrame([("en", big)], "lang string, n_words bigint")
    assert [(r.score, r.l, r.r) for r in collocations.score(counts, words).collect()] == [(10**6, big, big)]


# --- token counts ----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_windows_encode_as_the_middle_of_a_text(model):
    with open(PIECES, "rb") as f:
        pieces = token_counts.Pieces(f.read())
    for text in ("a b", " x", "é\n漢字😀", "\0▁ ", "  "):
        ids, at = pieces.window(text, True)
        assert ids.tolist() == model.encode(text)
        ids, at = pieces.window(text, False)
        data = b"".join(bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.encode() for i in ids.tolist() for p in [model.id_to_piece(i)])
        assert data.decode().replace("▁", " ") == text.replace("▁", " ")
        assert at.tolist() == sorted(at.tolist()) and all(0 <= a < len(text) or pieces.lengths[i] == 0 for a, i in zip(at, ids))


@pytest.mark.parametrize("window,overlap", [(64, 8), (64, 32), (700, 50)])
def test_spliced_counts_equal_the_library(spark, model, window, overlap):
    pick = random.Random(window)
    parts = ["a", "the ", " ", "  ", "\n", "é", "日本", "😀", "\0", "ing", "<s>", "</s>", "▁", "x" * 7, "\t", "hello world ", "́"]
    texts = ["".join(pick.choices(parts, k=pick.randrange(400))) for _ in range(120)]
    # runs that stay out of step however wide the overlap is
    texts += ["a" * 5001, " " * 3000, "ab" * 2000, "\n" * 900, "", None, "日" * 1000, "=-" * 1500, "word " * 700, "q" + " " * 2999]
    rows = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id int, text string, N_Tokens string").repartition(4)
    counted = token_counts.count_tokens(rows, token_counts.PieceModel(spark, PIECES), window=window, overlap=overlap)
    assert counted.columns == ["doc_id", "text", "n_tokens"]
    found = {r.doc_id: r.n_tokens for r in counted.collect()}
    assert found == {i: None if t is None else len(model.encode(t)) for i, t in enumerate(texts)}


def test_overlaps_are_widened_where_windows_are_out_of_step(spark):
    texts = spark.createDataFrame([(1, "a" * 4099), (2, "one two three " * 300)], "uid bigint, text string")
    model = token_counts.PieceModel(spark, PIECES)
    parts = token_counts._spliced(token_counts._encoded(token_counts._windows(texts, 130, 31), model, 130, 31)).collect()
    assert {r.uid: r.out_of_step > 0 for r in parts} == {1: True, 2: False}


def test_token_query(spark, con, model):
    found = {tuple(r) for r in QUERIES["op13_tokens"](spark, SF_DIR).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()}
    wanted = set()
    for doc_id, text in con.sql("select doc_id, coalesce(text, '') from documents").fetchall():
        n = len(model.encode(text))
        wanted.add((doc_id, len(text.encode()), n, n > 4096))
    assert found == wanted


def test_tokens_awkward(spark, awkward, model):
    counted = token_counts.count_tokens(awkward, token_counts.PieceModel(spark, PIECES))
    assert [c for c in counted.columns if c.lower() == "n_tokens"] == ["n_tokens"]
    rows = counted.collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter((i, None if t is None else len(model.encode(t))) for i, t in AWKWARD)
    assert all(r["UID"] == "UID" and r["start"] == "start" for r in rows)
    assert token_counts.count_tokens(awkward.limit(0), token_counts.PieceModel(spark, PIECES)).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(awkward, token_counts.PieceModel(spark, PIECES), window=10, overlap=6)


def test_a_document_without_an_id_is_not_held_out(spark, tmp_path):
    rows = [(i if i else None, f"some words of text {i} " * (i % 7 + 1)) for i in range(60)] + [(None, None), (7, "some words again")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(1, 60)] + [(None, 1)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    found = QUERIES["op5_quality"](spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.held_out is (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1


def test_blocks_are_written_and_read_one_at_a_time(spark, monkeypatch, tmp_path):
    import pyarrow.parquet as pq

    monkeypatch.setattr(collocations, "BLOCK_BYTES", 100)
    rows = spark.createDataFrame([(f"some words of text number {i}", "en") for i in range(200)], "text string, lang string").coalesce(1)
    with monkeypatch.context() as m:
        m.setattr(collocations, "scratch_path", lambda *_: f"file:{tmp_path}/blocks")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
        try:
            stored = collocations.blocks(rows)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert stored.selectExpr("sum(n_words)").first()[0] == 1200
    for file in (tmp_path / "blocks").glob("*.parquet"):
        found = pq.ParquetFile(file).metadata
        assert found.num_rows > 10 and found.num_row_groups == found.num_rows
        columns = {found.row_group(0).column(i).path_in_schema: found.row_group(0).column(i) for i in range(found.num_columns)}
        # values of megabytes are neither kept as limits of a row group nor in a dictionary
        assert all(not columns[c].is_stats_set and not columns[c].has_dictionary_page for c in ("hashes", "codes")) and columns["shard"].is_stats_set
