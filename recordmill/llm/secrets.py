"""Secret scans in DataFrame operations: fixed patterns and a battery of randomness tests.

Spans of three fixed kinds are found by patterns. What they cover is blanked, and so are
the characters that part a token which mixes two alphabets (``+`` and ``/`` with ``_`` and
``-``, as in a path): those of the alphabet whose tokens would be shorter. Beside the
fixed spans, every token of ``TOKEN`` characters that is left gets an encoding (the smallest alphabet that holds it) and three tests of the
hypothesis that its symbols are drawn at random: chi-squared uniformity over the alphabet,
runs above and below the middle, and serial correlation. A token is reported as ``random``
if the battery does not reject randomness and if ordinary writing would hardly look as
even: the p-value of its chi-squared under the repetition of ordinary text is held
against a Benjamini-Hochberg threshold over all documents, one for each length class, so
short tokens, which carry little evidence, have to be rarer to be believed.

Defined results: a null text counts as empty and has no spans; a text is read whole;
overlapping tokens of several kinds are all reported, except that ``random`` yields to the
fixed kinds; repeated rows are treated alike; all other columns pass through, whatever
their names, and one named ``spans`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.llm.common import spares, written

# The patterns of the base kinds, written for both Java's and DuckDB's syntax. Letters of
# keywords are given in both cases, since case folding would also admit letters beyond A to Z.
_KEYWORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
ASSIGN = rf"({_KEYWORDS})[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

TOKEN = 20
#: A battery p-value below this says that a token is not random.
REJECT = 0.01
#: Share of false discoveries among the random tokens of a length class.
FALSE_DISCOVERIES = 0.05
#: How often two letters of ordinary English agree; the languages around it repeat more.
#: Alphabets smaller than the letters get the same repetition relative to an even one.
COINCIDENCE, RELATIVE_COINCIDENCE = 0.0656, 1.73
#: Encodings by what a token consists of, smallest first. Digits alone are numbers, not keys.
ENCODINGS = (
    ("[0-9]", None),
    ("[0-9a-f]", "0123456789abcdef"),
    ("[0-9A-F]", "0123456789ABCDEF"),
    ("[A-Z2-7]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("[a-z0-9]", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("[A-Z0-9]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    ("[A-Za-z0-9]", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("[A-Za-z0-9+/]", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("[A-Za-z0-9_-]", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_BLOCK = 512  # matches per block of the running sums


def _starts(gaps: str, found: str) -> str:
    """Code point where each match starts, from the texts between matches and the matches.

    Running sums go by blocks, so that a text of very many matches costs little more than a
    few copies of a block for each.
    """
    sizes = f"zip_with(slice({gaps}, 1, size({found})), {found}, (g, m) -> length(g) + length(m))"
    none = "cast(array() as array<int>)"
    run = "(acc, x) -> named_struct('p', acc.p + x, 'a', concat(acc.a, array(acc.p))), acc -> acc.a"
    part = f"slice(s, b * {_BLOCK} + 1, {_BLOCK})"
    sums = f"transform(sequence(0, (size(s) - 1) div {_BLOCK}), b -> aggregate({part}, 0, (acc, x) -> acc + x))"
    bases = f"aggregate({sums}, named_struct('p', 0, 'a', {none}), {run})"
    places = f"flatten(transform({bases}, (base, b) -> aggregate({part}, named_struct('p', base, 'a', {none}), {run})))"
    return f"zip_with(transform(array({sizes}), s -> {places})[0], slice({gaps}, 1, size({found})), (p, g) -> p + length(g))"


def _upper_tail(z: str) -> str:
    """Probability that a normal variable exceeds ``z >= 0`` (absolute error below 1e-7)."""
    t = f"(1 / (1 + 0.2316419D * {z}))"
    series = f"{t} * (0.319381530D + {t} * (-0.356563782D + {t} * (1.781477937D + {t} * (-1.821255978D + {t} * 1.330274429D))))"
    return f"(exp(-{z} * {z} / 2) * 0.3989422804D * {series})"


def _above(z: str) -> str:
    return f"transform(array({z}), z -> if(z >= 0, {_upper_tail('z')}, 1 - {_upper_tail('(-z)')}))[0]"


def _both_sides(z: str) -> str:
    return f"transform(array(abs({z})), z -> 2 * {_upper_tail('z')})[0]"


def _blanked(text: str, gaps: str, found: str, blank: str) -> str:
    """The text with each match ``m``, the ``i``-th, replaced by something of its length."""
    return f"if(size({found}) = 0, {text}, array_join(zip_with({gaps}, concat(transform({found}, (m, i) -> {blank}), array('')), (g, m) -> concat(g, m)), ''))"


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_base``, the spans of the fixed kinds in order, and ``_tokens`` with their p-values."""
    out = df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    none = "cast(array() as array<string>)"
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
    out = out.withColumns({f"_f_{k}": F.expr(f"regexp_extract_all(_t, r'{p}', 0)") for k, p in patterns.items()})
    out = out.withColumns({
        f"_g_{k}": F.expr(f"if(size(_f_{k}) = 0, {none}, split(_t, r'{p}', -1))") for k, p in patterns.items()
    } | {"_values": F.expr(f"if(size(_f_assign) = 0, {none}, regexp_extract_all(_t, r'{ASSIGN}', 2))")})
    # blanks keep the length, so places in _m are places in the text
    out = out.withColumn("_m", F.expr(_blanked("_t", "_g_assign", "_f_assign", "if(length(_values[i]) >= 12, repeat(' ', length(m)), m)")))
    fixed = f"{ACCESS}|{HEX}"
    out = out.withColumn("_f_fixed", F.expr(f"if(size(_f_access) + size(_f_hex) = 0, {none}, regexp_extract_all(_m, r'{fixed}', 0))"))
    out = out.withColumn("_g_fixed", F.expr(f"if(size(_f_fixed) = 0, {none}, split(_m, r'{fixed}', -1))"))
    out = out.withColumn("_m", F.expr(_blanked("_m", "_g_fixed", "_f_fixed", "repeat(' ', length(m))")))
    token = f"[A-Za-z0-9+/_-]{{{TOKEN},}}"
    mixed = "m rlike '[+/]' and m rlike '[_-]'"
    longest = "array_max(transform(split(m, '{}'), x -> length(x)))".format
    parted = f"case when not ({mixed}) then m when {longest('[_-]')} > {longest('[+/]')} then translate(m, '_-', '  ') else translate(m, '+/', '  ') end"
    out = out.withColumn("_f_random", F.expr(f"regexp_extract_all(_m, r'{token}', 0)"))
    out = out.withColumn("_m", F.expr(f"if(exists(_f_random, m -> {mixed}), {_blanked('_m', f"split(_m, r'{token}', -1)", '_f_random', parted)}, _m)"))
    out = out.withColumn("_f_random", F.expr(f"if(size(_f_random) = 0, {none}, regexp_extract_all(_m, r'{token}', 0))"))
    out = out.withColumn("_g_random", F.expr(f"if(size(_f_random) = 0, {none}, split(_m, r'{token}', -1))"))
    out = out.withColumns({f"_s_{k}": F.expr(_starts(f"_g_{k}", f"_f_{k}")) for k in (*patterns, "random")})
    span = "transform(_f_{k}, (m, i) -> named_struct('start', _s_{k}[i], 'end', _s_{k}[i] + length(m), 'rank', {r}))"
    spans = [span.format(k=k, r=r) for r, k in enumerate(KINDS[:3])]
    spans[0] = f"filter({spans[0]}, (x, i) -> length(_values[i]) >= 12)"
    alphabet = " ".join(f"when m rlike '^{c}+$' then {'null' if a is None else repr(a)}" for c, a in ENCODINGS)
    named = f"filter(transform(_f_random, (m, i) -> named_struct('start', _s_random[i], 'token', m, 'alphabet', case {alphabet} end)), x -> x.alphabet is not null)"
    out = out.withColumns({"_base": F.expr(f"array_sort(concat({', '.join(spans)}), (x, y) -> case when x.start <> y.start then x.start - y.start else x.rank - y.rank end)"),
                           "_tokens": F.expr(named)})
    out = out.withColumn("_tokens", F.expr(_measured("_tokens")))
    out = out.withColumn("_tokens", F.expr(_tested("_tokens")))
    return out.drop("_t", "_m", "_values", *(f"_{a}_{k}" for a in "fgs" for k in (*KINDS, "fixed")))


def _measured(tokens: str) -> str:
    """What the tests need to know of each token."""
    values = "transform(slice(split(x.token, ''), 1, length(x.token)), c -> cast(instr(x.alphabet, c) as double))"
    return f"""transform({tokens}, x -> transform(array({values}), v -> named_struct(
        'start', x.start, 'n', length(x.token), 'k', length(x.alphabet),
        'squares', aggregate(array_distinct(split(x.token, '')), 0D, (s, c) -> s + if(c = '', 0D, pow(length(x.token) - length(replace(x.token, c, '')), 2))),
        'bits', translate(x.token, x.alphabet, concat(repeat('0', length(x.alphabet) div 2), repeat('1', length(x.alphabet) - length(x.alphabet) div 2))),
        's1', aggregate(v, 0D, (s, y) -> s + y), 's2', aggregate(v, 0D, (s, y) -> s + y * y),
        's11', aggregate(zip_with(v, concat(slice(v, 2, size(v)), slice(v, 1, 1)), (a, b) -> a * b), 0D, (s, y) -> s + y)))[0])"""


def _tested(tokens: str) -> str:
    chi = "(x.k * x.squares / x.n - x.n)"
    ones = "(x.n - length(replace(x.bits, '1', '')))"
    runs = "(1 + (x.n - length(replace(x.bits, '01', ''))) / 2 + (x.n - length(replace(x.bits, '10', ''))) / 2)"
    pairs = f"(2D * {ones} * (x.n - {ones}))"
    cube = f"((pow({chi} / (x.k - 1), 1 / 3D) - (1 - 2 / (9D * (x.k - 1)))) / sqrt(2 / (9D * (x.k - 1))))"
    run_z = f"coalesce(try_divide({runs} - 1 - {pairs} / x.n, sqrt({pairs} * ({pairs} - x.n) / (pow(x.n, 2) * (x.n - 1)))), 99D)"
    serial = "coalesce(try_divide(x.n * x.s11 - x.s1 * x.s1, x.n * x.s2 - x.s1 * x.s1), 1D)"
    serial_z = f"(({serial} + 1 / (x.n - 1D)) / (x.n / ((x.n - 1D) * sqrt(x.n - 2D))))"
    extra = f"(x.n * (if(x.k >= 26, x.k * {COINCIDENCE}D, {RELATIVE_COINCIDENCE}D) - 1))"
    even = f"(({chi} - (x.k - 1) - {extra}) / sqrt(2 * (x.k - 1) + 4 * {extra}))"
    return f"""transform({tokens}, x -> named_struct('start', x.start, 'end', x.start + x.n, 'class', cast(floor(log2(x.n)) as int),
        'p_random', least(1D, 3 * least({_above(cube)}, {_both_sides(f'least(99D, {run_z})')}, {_both_sides(serial_z)})),
        'p_ordinary', greatest(1e-12D, 1 - {_above(even)})))"""


def thresholds(scanned: DataFrame, share: float = FALSE_DISCOVERIES) -> dict[int, float]:
    """The largest p-value believed in each length class, by Benjamini and Hochberg over all documents.

    P-values are counted in steps of a twentieth of a decade, so the driver sees at most 241
    rows for each of at most 31 length classes.
    """
    tokens = scanned.select(F.explode("_tokens").alias("x")).select("x.class", F.floor(-20 * F.log10("x.p_ordinary")).cast("int").alias("step"))
    counts: dict[int, dict[int, int]] = {}
    for row in tokens.groupBy("class", "step").count().collect():
        counts.setdefault(row["class"], {})[row["step"]] = row["count"]
    found = {}
    for kind, steps in counts.items():
        total, below = sum(steps.values()), 0
        for step in sorted(steps, reverse=True):
            below += steps[step]
            edge = 10 ** (-step / 20)
            if edge * total <= share * below:
                found[kind] = edge
    return found


@spares("_t", "_m", "_base", "_tokens", "_values", *(f"_{a}_{k}" for a in "fgs" for k in (*KINDS, "fixed")))
def find(df: DataFrame, text: str = "text", share: float = FALSE_DISCOVERIES, keep_text: bool = True) -> DataFrame:
    """Adds ``spans``: ``array<struct<start, end, rank>>``, code points with exclusive ends, ``rank`` into ``KINDS``.

    What the scan of the texts finds is stored once, with the other columns of ``df``.
    """
    scanned = scan(df.drop("spans"), text)
    stored = written(scanned if keep_text else scanned.drop(text), "secrets")
    believed = thresholds(stored, share)
    limit = f"case x.class {' '.join(f'when {k} then {v!r}D' for k, v in sorted(believed.items()))} else -1D end" if believed else "-1D"
    free = "not exists(_base, b -> b.start < x.end and x.start < b.end)"
    random = f"transform(filter(_tokens, x -> x.p_random >= {REJECT}D and x.p_ordinary <= {limit} and {free}), x -> named_struct('start', x.start, 'end', x.end, 'rank', 3))"
    return stored.withColumn("spans", F.expr(f"array_sort(concat(_base, {random}), (x, y) -> case when x.start <> y.start then x.start - y.start else x.rank - y.rank end)")).drop("_base", "_tokens")


def listing(spans: str = "spans", base_only: bool = False) -> Column:
    """Spans as ``kind:start:end`` joined by commas."""
    kind = f"element_at(array({', '.join(map(repr, KINDS))}), x.rank + 1)"
    kept = f"filter({spans}, x -> x.rank < 3)" if base_only else spans
    return F.expr(f"array_join(transform({kept}, x -> concat({kind}, ':', x.start, ':', x.end)), ',')")


def redact(df: DataFrame, text: str = "text", spans: str = "spans", mark: str = "[SECRET]") -> DataFrame:
    """The text with each span, or run of overlapping spans, replaced by a mark; a null text stays null."""
    piece = f"if(x.start >= acc.at, array(substring({text}, acc.at + 1, x.start - acc.at), '{mark}'), cast(array() as array<string>))"
    joined = (f"aggregate({spans}, named_struct('at', 0, 'parts', cast(array() as array<string>)), "
              f"(acc, x) -> named_struct('at', greatest(acc.at, x.end), 'parts', concat(acc.parts, {piece})), "
              f"acc -> concat(array_join(acc.parts, ''), substring({text}, acc.at + 1)))")
    return df.withColumn(text, F.expr(f"if(size({spans}) > 0, {joined}, {text})"))
