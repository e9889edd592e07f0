"""Registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.llm import (
    bpe, collocations, lexical_search, licences, packing, pivot_search, quality_classifier, quotations, rule_forest, secrets, simhash,
    suffix_dedup, token_counts,
)
from recordmill.llm.common import table, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Tokens a document may have before it counts as too long.
TOKEN_LIMIT = 4096


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the text they decode to, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = bpe.encode(docs, bpe.Vocabulary(spark, VOCABULARY), decoded="decoded")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of at most 1,024."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = packing.pieces(docs, bpe.Vocabulary(spark, VOCABULARY), payload="ids_crc32")
    return packing.pack(parts)


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every text and the component it belongs to, links within three bits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = written(simhash.fingerprints(docs).drop("text"), "simhash")
    return simhash.group(prints, "doc_id").select(
        "doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


@query
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text: counts and digest of the fixed kinds, and all spans."""
    found = secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    count = "cast(size(filter(spans, x -> x.rank = {})) as long)"
    return found.select(
        "doc_id", *(F.expr(count.format(i)).alias(f"n_{k}") for i, k in enumerate(secrets.KINDS[:3])),
        F.sha2(secrets.listing(base_only=True), 256).alias("base_sha256"), secrets.listing().alias("spans"))


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality score of every text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    features = written(quality_classifier.featurize(docs).drop("text"), "features")
    rows = written(quality_classifier.labelled(features, table(spark, sf_dir, "labels")), "labelled")
    scored = quality_classifier.score(features, quality_classifier.fit(rows))
    # a document without an id is in no part; it cannot be labelled either
    held_out = F.coalesce(quality_classifier.remainder() == 2, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics of every text, the base rules and the forest's verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = written(rule_forest.count(docs).drop("text"), "rules")
    return rule_forest.judge(counted, table(spark, sf_dir, "labels")).select("doc_id", *rule_forest.COUNTS, "base_failed", "kept", "anomaly")


@query
def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the bytes of passages that repeat, as counts and a digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove(docs).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.expr("aggregate(removed, 0L, (n, s) -> n + s.end - s.start)").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector with all others."""
    return pivot_search.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "id % 100 = 0")


ORACLE["op3_topk"] = """
with v as (
    select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
    where vec_id is not null and embedding is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select q.r as asked, q.vec_id as query_id, v.vec_id, cast(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) as bigint) as score
    from v q join v on q.r <> v.r and len(q.e) = len(v.e) where q.vec_id % 100 = 0
), r as (select *, row_number() over (partition by asked order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10
"""


@query
def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every text: how many, how many of unknown family, and the families confirmed."""
    found = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.size("notices").cast("long").alias("n_notices"),
        F.expr(f"cast(size(filter(notices, x -> x.family = '{licences.UNKNOWN}')) as long)").alias("n_unknown"),
        F.expr(f"array_join(array_sort(array_distinct(filter(transform(notices, x -> x.family), f -> f <> '{licences.UNKNOWN}'))), ',')").alias("families"))


@query
def op6_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message in its place in the conversation, without quotes, in the order of replies."""
    linked = quotations.link(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return linked.select(
        "conv_id", "turn", "role", F.size("quote_levels").alias("n_levels"), "parent_turn", "root_turn", "depth", F.md5("own_text").alias("own_md5"),
    ).orderBy("conv_id", "root_turn", "turn")


ORACLE["op6_quotations"] = r"""
with recursive lines as (
    select conv_id, turn, text, unnest(range(len(string_split(text, chr(10))))) as n, unnest(string_split(text, chr(10))) as raw from (select distinct conv_id, turn, text from conversations)
), marked as (
    select conv_id, turn, text, n, rtrim(raw, chr(13)) as l from lines
), leveled as (
    select conv_id, turn, text, n, len(replace(regexp_extract(l, '^(?: ?>)+'), ' ', '')) as level, regexp_replace(l, '^(?: ?>)+ ?', '') as line from marked
), levels as (
    select distinct conv_id, turn, text, level from leveled
), layers as (
    select v.conv_id, v.turn, v.text, v.level,
        string_agg(case when l.level = v.level then l.line when v.level > 0 then '' end, chr(10) order by l.n) as layer
    from levels v join leveled l using (conv_id, turn, text) group by all
), units as (
    select conv_id, turn, text, level, unnest(regexp_split_to_array(layer, '\n[ \t]*\n')) as passage from layers
    union all
    select conv_id, turn, text, 0, string_agg(line, chr(10) order by n) from leveled where level = 0 group by all
), hashed as (
    select conv_id, turn, level, trim(lower(regexp_replace(passage, '[\x20\x09-\x0D\xA0]+', ' ', 'g'))) as passage from units
), firsts as (
    select conv_id, passage, min(turn) as origin from hashed where level = 0 and passage <> '' group by all
), found as (
    select h.conv_id, h.turn, h.level, max(f.origin) as origin from hashed h join firsts f using (conv_id, passage) where h.level > 0 and f.origin < h.turn group by all
), parents as (
    select conv_id, turn, arg_min(origin, level) as parent from found group by all
), walk as (
    select conv_id, turn, parent, parent as root, 1 as depth from parents
    union all
    select w.conv_id, w.turn, w.parent, p.parent, w.depth + 1 from walk w join parents p on p.conv_id = w.conv_id and p.turn = w.root
), places as (
    select conv_id, turn, any_value(parent) as parent, arg_max(root, depth) as root, max(depth) as depth from walk group by all
), own as (
    select conv_id, turn, text, string_agg(line, chr(10) order by n) filter (level = 0) as own_text, count(distinct level) filter (level > 0) as n_levels,
        bool_or(level > 0) as quoted from leveled group by all
)
select c.conv_id, c.turn, c.role, cast(coalesce(o.n_levels, 0) as integer) as n_levels, p.parent as parent_turn, coalesce(p.root, c.turn) as root_turn,
    cast(coalesce(p.depth, 0) as integer) as depth, md5(case when o.quoted then coalesce(o.own_text, '') else c.text end) as own_md5
from conversations c left join own o on o.conv_id is not distinct from c.conv_id and o.turn is not distinct from c.turn and o.text = c.text
left join places p on p.conv_id = c.conv_id and p.turn = c.turn
"""


@query
def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    index = lexical_search.build(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lexical_search.search(index, table(spark, sf_dir, "benchmark").select("item_id", "text"))


ORACLE["op11_lexical"] = r"""
with terms as (
    select r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from (select row_number() over () as r, doc_id, text from documents where text is not null)
), sizes as (
    select r, any_value(doc_id) as doc_id, cast(count(*) as bigint) as n from terms group by r
), whole as (
    select cast(count(*) as bigint) as docs, cast(sum(n) as bigint) as len from sizes
), tf as (
    select r, term, cast(count(*) as bigint) as tf from terms group by r, term
), items as (
    select item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from (select distinct item_id, text from benchmark where text is not null)
), asked as (
    select item_id, text, term, cast(count(*) as bigint) as times from items group by all
), weights as (
    select term, cast(floor(1000 * ln((2.0::double * docs + 2) / (2 * count(*) + 1))) as bigint) as w from tf, whole where term in (select term from asked) group by term, docs
), scores as (
    select a.item_id, a.text, r, any_value(s.doc_id) as doc_id,
        cast(sum(a.times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // len)))) as bigint) as score
    from asked a join weights using (term) join tf using (term) join sizes s using (r), whole group by a.item_id, a.text, r
), ranked as (
    select *, row_number() over (partition by item_id, text order by score desc, doc_id nulls last) as rank from scores where score > 0
)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 10
"""


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language."""
    return collocations.mine(table(spark, sf_dir, "documents").select("text", "lang"))


ORACLE["op12_collocations"] = r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents where text is not null
), words as (
    select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') as w from pieces
), grams as (
    select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) as phrase
    from words, (select unnest([1, 2, 3, 4]) as k) where len(w) >= k
), f as (
    select lang, phrase, k, cast(count(*) as bigint) as a from grams group by all having count(*) >= 30
), totals as (
    select lang, cast(sum(len(w)) as bigint) as n from words group by lang
), held as (
    select lang, phrase, max(a) as longer from (
        select lang, a, unnest(flatten(list_transform(range(2, k), lambda j: list_transform(range(1, k - j + 2), lambda i: array_to_string(list_slice(string_split(phrase, ' '), i, i + j - 1), ' '))))) as phrase
        from f where k > 2
    ) group by all
), alive as (
    select f.* from f left join held using (lang, phrase) where f.k > 1 and (longer is null or 100 * longer < 80 * a)
), cuts as (
    select lang, phrase, a, c, array_to_string(list_slice(string_split(phrase, ' '), 1, c), ' ') as head, array_to_string(list_slice(string_split(phrase, ' '), c + 1, k), ' ') as tail
    from (select *, unnest(range(1, k)) as c from alive)
), scored as (
    select c.*, x.a as l, y.a as r, cast((2000000::hugeint * c.a) // (x.a::hugeint + y.a) as bigint) as score
    from cuts c join f x on x.lang = c.lang and x.phrase = c.head join f y on y.lang = c.lang and y.phrase = c.tail
), weakest as (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1
), ranked as (
    select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from weakest
)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""


@query
def op13_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = token_counts.count_tokens(docs, token_counts.PieceModel(spark, PIECES))
    return counted.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))
