"""Quotation linking: quoted passages are joined to the messages they come from.

A line's quote level is the number of ``>`` marks it begins with. The runs of non-blank
lines of one level are passages; their normalised text (lower case, blanks collapsed) is
hashed. A passage of level one or more is joined with the first message of the same
conversation that holds it as its own text, as one of its passages or in whole; own passages
are also those that remain when the quotes between their lines are left out. The parent
of a message is the latest earlier message that its passages of the lowest linked level
come from. Following parents gives the root and depth of every message; in the order of
conversation, root, turn, replies follow what they answer, and a message's own text comes
without its quotes. Keys are counted before they are joined: each passage has one original.

Defined results: a null text has no lines and a null own text; a message without a linked
quote is a root of depth zero; quotes of later messages, of other conversations, or of
itself link to nothing; rows with null conversation or turn are roots; repeated rows stay
and are linked alike; blank quotes link to nothing. Texts are read whole; other columns pass
through, those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm.common import written

#: The marks before a quoted line, each of which may follow a space.
MARKS = r"^(?:\x20?>)+"
BLANK = r"[\x20\x09-\x0D\xA0]+"


def parse(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``own_text``, ``quote_levels`` (the levels present) and ``_passages``: ``array<struct<level, hash>>``."""
    lines = F.expr(rf"transform(split({text}, r'\r?\n', -1), l -> named_struct('level', length(replace(regexp_extract(l, r'{MARKS}', 0), ' ', '')), 'line', regexp_replace(l, r'{MARKS}\x20?', '')))")
    plain = F.expr(rf"{text} is null or not {text} rlike r'(?m){MARKS}'")
    out = df.withColumn("_lines", F.when(~plain, lines))
    out = out.withColumns({
        "own_text": F.when(plain, F.col(text)).otherwise(F.expr("array_join(transform(filter(_lines, l -> l.level = 0), l -> l.line), '\n')")),
        "quote_levels": F.when(plain, F.expr("cast(array() as array<int>)")).otherwise(F.expr("array_sort(array_distinct(filter(transform(_lines, l -> l.level), v -> v > 0)))")),
    })
    # a blank line ends a passage, and so does a line of another level
    quoted = r"flatten(transform(quote_levels, v -> transform(split(array_join(transform(_lines, l -> if(l.level = v, l.line, '')), '\n'), r'\n[\x20\t]*\n', -1), p -> named_struct('level', v, 'passage', p))))"
    # own text is quoted with and without the quotes it answers, so both ways to cut it count
    parts = r"if(size(quote_levels) > 0, split(array_join(transform(_lines, l -> if(l.level = 0, l.line, '')), '\n'), r'\n[\x20\t]*\n', -1), cast(array() as array<string>))"
    own = rf"transform(array_distinct(concat({parts}, split(own_text, r'\r?\n[\x20\t]*\r?\n', -1), array(own_text))), p -> named_struct('level', 0, 'passage', p))"
    out = out.withColumn("_passages", F.expr(f"concat(if(size(quote_levels) > 0, {quoted}, cast(array() as array<struct<level: int, passage: string>>)), coalesce({own}, cast(array() as array<struct<level: int, passage: string>>)))"))
    tidy = rf"transform(_passages, p -> named_struct('level', p.level, 'passage', trim(lower(regexp_replace(p.passage, r'{BLANK}', ' ')))))"
    return out.withColumn("_passages", F.expr(f"transform(filter({tidy}, p -> p.passage <> ''), p -> named_struct('level', p.level, 'hash', md5(p.passage)))")).drop("_lines")


def link(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Adds ``own_text``, ``quote_levels``, ``parent_turn``, ``root_turn`` and ``depth``."""
    results = ("own_text", "quote_levels", "parent_turn", "root_turn", "depth")
    stored = written(parse(df.drop(*results), text), "messages")
    passages = stored.select(F.col(conversation).alias("_conv"), F.col(turn).alias("_turn"), F.explode("_passages").alias("p")).select("_conv", "_turn", "p.level", "p.hash")
    first = passages.filter("level = 0").groupBy("_conv", "hash").agg(F.min("_turn").alias("_from"))
    quotes = passages.filter("level > 0").distinct()
    found = quotes.join(first, ["_conv", "hash"]).filter("_from < _turn").groupBy("_conv", "_turn", "level").agg(F.max("_from").alias("_from"))
    parents = written(found.groupBy("_conv", "_turn").agg(F.min_by("_from", "level").alias("_parent")), "parents")
    places = _roots(parents)
    joined = stored.drop("_passages").join(places, (F.col(conversation) == F.col("_conv")) & (F.col(turn) == F.col("_turn")), "left")
    return joined.withColumns({
        "parent_turn": F.col("_parent"), "root_turn": F.coalesce("_root", F.col(turn)), "depth": F.coalesce("_depth", F.lit(0)),
    }).drop("_conv", "_turn", "_parent", "_root", "_depth")


def _roots(parents: DataFrame) -> DataFrame:
    """Root and depth of every message with a parent, by doubling the steps; rounds grow with the logarithm of the depth."""
    now = parents.select("_conv", "_turn", "_parent", F.col("_parent").alias("_root"), F.lit(1).alias("_depth"))
    while True:
        up = now.select("_conv", F.col("_turn").alias("_root"), F.col("_root").alias("_next"), F.col("_depth").alias("_more"))
        step = written(now.join(up, ["_conv", "_root"], "left"), "roots")
        moved = step.filter("_next is not null").count()
        now = step.select("_conv", "_turn", "_parent", F.coalesce("_next", "_root").alias("_root"), (F.col("_depth") + F.coalesce("_more", F.lit(0))).alias("_depth"))
        if not moved:
            return now
