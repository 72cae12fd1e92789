r"""Secret scans by a randomness test battery, in DataFrame and SQL functions only.

Base kinds have fixed patterns and always stay. Further candidates are long tokens over base-64 letters that hold digits and letters. For
each its encoding is inferred (the smallest of hexadecimal, base 32, 36, 62 and 64 whose letters hold it), and three tests of its letters' numbers
give p-values under uniform letters of that encoding and the token's length: chi-squared for uniform use of the alphabet (one-sided, with the small-sample
variance), the number of changes across the alphabet's middle, and serial correlation (both two-sided, by their normal limits). They are combined as
-(2 ln p1 + ln p2 + ln p3), whose law under independence is known; a token is less like noise the smaller its combined p is.

A token whose p is at least its length class's cut is reported. The cut is the least p, from KEEP on, at which the false share of what is reported is at most
`rate`: true random tokens above a cut are estimated from the p-values beyond a half, where those of words and identifiers hardly lie (Storey's estimate with
its finite-sample correction), what is reported beyond them and two standard deviations of chance counts as false. So long tokens are not judged with short ones, KEEP is the share of random tokens
that is given up at least (less of long ones, which differ more from words), and a lone token is judged by the same rule as one among millions.

Only counts by length class and step of p reach the driver; there is no shuffle of texts. Texts are scanned once, in time linear in
their length: base spans and tokens' p-values are written, and the cuts and the decision read them.

Defined cases: a null text is empty and has no spans; repeated rows are judged each; null ids are carried; an empty table
has no cuts and no rows. Places count code points, ends are exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.llm.located import apart, bound, matches, quoted
from rastermill.llm.shared import saved

# The base kinds' patterns, in the order in which spans that start together are listed.
BASE = {
    "assign": (r"(?i:password|passwd|secret|token|api_?key)[\x22\x27]?[ ]*[:=][ ]*[\x22\x27]?[A-Za-z0-9+/_.=-]+", "(instr(t, ':') > 0 OR instr(t, '=') > 0) AND t RLIKE '(?i)(?:passw|secret|token|api_?key)'"),
    "access": (r"AKIA[A-Z0-9]{16,}+", "instr(t, 'AKIA') > 0"),
    "hex": (r"[0-9a-f]{24,}+", "runs"),
}
KINDS = [*BASE, "random"]
#: What follows the keyword and its sign in an assignment; the value must have 6 characters.
VALUE = r"^(?i:password|passwd|secret|token|api_?key)[\x22\x27]?[ ]*[:=][ ]*[\x22\x27]?([A-Za-z0-9+/_.=-]+)$"
#: A part of every token, and so of every match of `hex`.
RUN = r"[A-Za-z0-9+/_=-]{20}"
TOKEN = r"(?:\G|(?<![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{20,}+"
# The alphabets, in their own order, by size.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {16: DIGITS + "abcdef", 32: UPPER + "234567", 36: LOWER + DIGITS, 62: UPPER + LOWER + DIGITS, 64: UPPER + LOWER + DIGITS + "+/"}
#: Upper ends of the length classes.
LENGTHS = (24, 32, 48, 64, 128)
#: Steps of p from 0 to 1, where p-values count as those of random tokens, and the least cut of each length class, in steps.
STEPS, RANDOM_FROM, KEEP = 200, 100, (10, 6, 2, 1, 1, 1)


def _tail(z: str) -> str:
    """SQL: -ln of the normal chance of more than z."""
    return f"ln(1 + exp(least(700D, greatest(-700D, 1.5976D * ({z}) + 0.07056D * ({z}) * ({z}) * ({z})))))"


def _p(v: str, k: str) -> str:
    """SQL: the combined p-value of v (numbers of letters from 0), k being the size of the alphabet."""
    counts = "transform(array_distinct(q.v), y -> size(filter(q.v, z -> z = y)))"  # at most 64 letters
    squares = f"(aggregate({counts}, 0D, (a, y) -> a + CAST(y AS DOUBLE) * y) * q.k / q.n - q.n)"
    scale = "(2D * (q.n - 1) / (9 * (q.k - 1) * q.n))"  # Wilson and Hilferty, for the small sample's variance
    chi = f"(cbrt(greatest(0D, {squares} / (q.k - 1))) - 1 + {scale}) / sqrt({scale})"
    changes = "size(filter(sequence(2, q.n), i -> (2 * get(q.v, i - 1) >= q.k) <> (2 * get(q.v, i - 2) >= q.k)))"
    runs = f"abs(({changes} - (q.n - 1) / 2D) / sqrt((q.n - 1) / 4D))"
    mean = "(q.k - 1) / 2D"
    together = f"aggregate(sequence(2, q.n), 0D, (a, i) -> a + (get(q.v, i - 1) - {mean}) * (get(q.v, i - 2) - {mean}))"
    correlation = f"abs({together} / ((q.k * q.k - 1) / 12D * sqrt(q.n - 1)))"
    z = f"named_struct('c', {chi}, 'r', {runs}, 's', {correlation})"
    y = f"greatest(0D, 2 * {_tail('z.c')} + {_tail('z.r')} + {_tail('z.s')} - 2 * ln(2D))"
    combined = bound(z, "z", bound(y, "y", "least(1D, greatest(0D, 4 * exp(-y / 2) - (y + 3) * exp(-y)))"))
    return bound(v, "v", bound(k, "k", bound("named_struct('v', v, 'k', k, 'n', size(v))", "q", combined)))


def _shaped(tokens: str) -> str:
    """SQL: (s, e, l, mixed, k, v) of each token: length class, whether it has digits and letters, size of its alphabet and numbers of its letters."""
    body = "rtrim('=', x.m)"
    kinds = {16: "[0-9a-fA-F]", 32: "[A-Z2-7]", 36: "[a-z0-9]", -36: "[A-Z0-9]", 62: "[A-Za-z0-9]"}  # minus: in capitals
    kind = "CASE " + " ".join(f"WHEN {body} RLIKE '^{c}+$' THEN {k}" for k, c in kinds.items()) + " ELSE 64 END"
    letters = "CASE abs(k) " + " ".join(f"WHEN {k} THEN '{a}'" for k, a in ALPHABETS.items()) + " END"
    cased = f"CASE WHEN k IN (16, -36) THEN lower({body}) WHEN k = 64 THEN translate({body}, '-_', '+/') ELSE {body} END"
    length = "CASE " + " ".join(f"WHEN x.e - x.s <= {n} THEN {i}" for i, n in enumerate(LENGTHS)) + f" ELSE {len(LENGTHS)} END"
    values = bound(letters, "letters", f"transform(filter(split({cased}, ''), y -> y <> ''), y -> instr(letters, y) - 1)")
    found = f"named_struct('s', x.s, 'e', x.e, 'l', {length}, 'mixed', x.m RLIKE '[0-9]' AND x.m RLIKE '[A-Za-z]', 'k', abs(k), 'v', {values})"
    return f"transform({tokens}, x -> {bound(kind, 'k', found)})"


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, base (s, k, e ordered) and tokens (s, e, l, p): candidates with their length class and combined p-value."""
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    df = df.withColumn("runs", F.expr(f"t RLIKE {quoted(RUN)}"))
    df = df.select("id", *[matches("t", p, w).alias(f"p_{k}") for k, (p, w) in BASE.items()], matches("t", TOKEN, "runs").alias("tokens"))
    kept = F.expr(f"filter(p_assign, x -> char_length(regexp_extract(x.m, r'{VALUE}', 1)) >= 6)")
    df = df.withColumn("p_assign", kept)
    base = "concat(" + ", ".join(f"transform(p_{k}, x -> named_struct('s', x.s, 'k', {i}, 'e', x.e))" for i, k in enumerate(BASE)) + ")"
    df = df.select("id", F.expr(f"array_sort({base})").alias("base"), F.expr(_shaped("tokens")).alias("shaped"))
    fine = "x -> size(x.v) >= 8 AND x.mixed"
    return df.select("id", "base", F.expr(f"transform(filter(shaped, {fine}), x -> named_struct('s', x.s, 'e', x.e, 'l', x.l, 'p', {_p('x.v', 'x.k')}))").alias("tokens"))


def cuts(tokens: DataFrame, rate: float) -> list[float]:
    """By length class: the least p that is reported."""
    steps = tokens.select(F.explode("tokens").alias("x")).select("x.l", F.floor(F.col("x.p") * STEPS).cast("int").alias("b"))
    counts = steps.groupBy("l", "b").count().collect()  # classes x steps
    least = []
    for i in range(len(LENGTHS) + 1):
        have = [0] * (STEPS + 1)
        for r in counts:
            if r["l"] == i:
                have[r["b"]] = r["count"]
        random = (1 + sum(have[RANDOM_FROM:])) / (1 - RANDOM_FROM / STEPS)
        for cut in range(KEEP[i], RANDOM_FROM + 1):
            reported = sum(have[cut:])
            if reported - random * (1 - cut / STEPS) - 2 * math.sqrt(reported) <= rate * reported:
                break
        least.append(cut / STEPS)
    return least


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """id, base and spans: arrays of (s, k, e) ordered by start, then kind; k is the place in KINDS.

    spans holds the base spans and the tokens that reach their class's cut and touch no base span.
    """
    found = saved(scanned(docs, id_col, text_col), "tokens")
    least = "array(" + ", ".join(f"{x!r}D" for x in cuts(found, rate)) + ")"
    passed = f"transform(filter(tokens, x -> x.p >= element_at({least}, x.l + 1)), x -> named_struct('s', x.s, 'k', {len(BASE)}, 'e', x.e))"
    both = found.select("id", "base", F.expr(passed).alias("more"))
    return both.select("id", "base", F.expr(f"array_sort(concat(base, {apart('more', 'base')}))").alias("spans"))


def listed(spans: str) -> str:
    """SQL: kind:start:end of the spans, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, x -> concat(element_at({names}, x.k + 1), ':', x.s, ':', x.e)), ',')"
