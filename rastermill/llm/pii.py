r"""Personal data by weak supervision, in DataFrame and SQL functions only.

Candidates are spans of nine kinds. The four base kinds have fixed patterns and checks and always stay; the others are looser.
Three labelers vote on every candidate: a regular expression (strict shape), a gazetteer (known beginnings and endings)
and a context labeler (cue words before the span). The corpus's votes are counted by pattern; expectation-maximisation with
conditionally independent labelers estimates each one's reliability and the share of true spans per kind, and a logistic
span classifier over kind, votes and length is trained on the posteriors. It decides on the looser candidates.

Only counts by pattern reach the driver (kinds x 8 votes x 4 length classes); there is no shuffle of texts. Texts are scanned
once: candidates are written, and both training and decision read them.

Time is linear in a text, however many matches it has. Patterns are written so that no run of characters is scanned again
from each of its places: a match begins where a run begins or the previous match ended (\G), which leaves the leftmost
non-overlapping matches as they are; card numbers are runs of 16 to 19 digits between which at most one space or dash
stands, begun and ended where the base pattern's runs are. Cheaper tests come first, which every match passes.

Defined cases: a null text is empty and has no spans; repeated rows are judged each; null ids are carried; an empty table
gives an empty result; other columns are not looked at. Places count code points, ends are exclusive.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastermill.llm.located import apart, matches, quoted, replaced
from rastermill.llm.shared import saved

# The base kinds' patterns and checks, in the order in which spans are listed.
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "instr(t, '@') > 0"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "digits"),
    "card": (r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])", "digits"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "instr(t, '+') > 0 AND digits"),
}
#: A part of every match of the kinds that look at `digits`: seven characters of these at least.
DIGITS = r"[0-9][ ().0-9-]{5}"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Looser kinds: pattern, when to look, and the labelers' strict shape.
LOOSE = {
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "digits", r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", r"t RLIKE r'[A-Z]{2}[0-9]{2}[A-Z0-9]{11}'", r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{4}[0-9]{7}[A-Z0-9]{0,16}$"),
    "localphone": (r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])", "digits", r"^\(?[2-9][0-9]{2}\)?[ .-]?[2-9][0-9]{2}[.-][0-9]{4}$"),
    "person": (r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?", "instr(t, 'Mr') > 0 OR instr(t, 'Ms') > 0 OR instr(t, 'Dr') > 0 OR instr(t, 'Prof') > 0", r"^(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]+ [A-Z][a-z]+$"),
    "mac": (r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])", "instr(t, ':') > 0 AND t RLIKE '(?:[0-9A-Fa-f]{2}:){5}'", r"^(?:[0-9A-F]{2}:){5}[0-9A-F]{2}$|^(?:[0-9a-f]{2}:){5}[0-9a-f]{2}$"),
}
KINDS = [*BASE, *LOOSE]
#: Gazetteer: known beginnings or endings of each kind.
KNOWN = {
    "email": r"\.(?:com|org|net|edu|gov|io|de|fr|es|uk|info)$",
    "ip": r"^(?:10\.|127\.|172\.|192\.168\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^\+(?:1|33|34|39|44|49|61|81|86|91)",
    "ssn": r"^[0-8]",
    "iban": r"^(?:AT|BE|CH|DE|ES|FR|GB|IT|NL|PL|SE)",
    "localphone": r"^\(?(?:2|3|4|5|6|7|8|9)",
    "person": r" (?:Anna|Carlos|David|Elena|Hans|James|John|Jose|Juan|Julia|Laura|Maria|Marie|Mary|Michael|Paul|Peter|Robert|Sarah|Thomas)(?: |$)",
    "mac": r"^(?:00|08|3c|ac|b8|dc)",
}
CUES = {
    "email": "mail|contact|write|@|correo|courriel",
    "ip": "ip|host|address|server|from|adresse",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|anruf",
    "ssn": "ssn|social|security|tax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "localphone": "phone|tel|call|mobile|fax",
    "person": "name|dear|by|from|author|patient|regards",
    "mac": "mac|device|adapter|ethernet|hardware",
}
LENGTHS = (12, 20, 30)


def _checked(kind: str) -> Column:
    """Base spans of a kind: matches that pass its check."""
    spans = f"p_{kind}"
    if kind == "ip":
        return F.expr(f"filter({spans}, x -> x.m RLIKE {quoted('^' + BYTE + '(?:[.]' + BYTE + '){3}$')})")
    if kind == "card":
        digits = "reverse(regexp_replace(x.m, '[^0-9]', ''))"
        double = "substr('0246813579', 1 + CAST(substr(d, i, 1) AS INT), 1)"
        luhn = f"aggregate(sequence(1, char_length(d)), 0, (a, i) -> a + CAST(CASE WHEN i % 2 = 0 THEN {double} ELSE substr(d, i, 1) END AS INT)) % 10 = 0"
        return F.expr(f"filter({spans}, x -> exists(filter(array({digits}), d -> char_length(d) BETWEEN 16 AND 19), d -> {luhn}))")
    if kind == "phone":
        return F.expr(f"filter({spans}, x -> char_length(regexp_replace(x.m, '[^0-9]', '')) BETWEEN 8 AND 15)")
    return F.col(spans)


def _voted(kind: str) -> Column:
    """A kind's candidates with votes: k, s, e, r, g, c and length class l."""
    strict = "1" if kind in BASE else f"CAST(x.m RLIKE {quoted(LOOSE[kind][2])} AS INT)"
    length = "CASE " + " ".join(f"WHEN x.e - x.s < {n} THEN {i}" for i, n in enumerate(LENGTHS)) + f" ELSE {len(LENGTHS)} END"
    return F.expr(
        f"""transform(c_{kind}, x -> named_struct('k', {KINDS.index(kind)}, 's', x.s, 'e', x.e, 'r', {strict},
            'g', CAST(x.m RLIKE {quoted(KNOWN[kind])} AS INT),
            'c', CAST(x.c RLIKE {quoted('(?i)(?:' + CUES[kind] + ')')} AS INT), 'l', {length}))"""
    )


def candidates(docs: DataFrame, id_col: str, text_col: str, keep_text: bool = True) -> DataFrame:
    """id, t (the text, if wished) and cands: all candidates with their votes, in the order of kinds, then places."""
    kept = ["id", "t"] if keep_text else ["id"]
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    df = df.withColumn("digits", F.expr(f"t RLIKE {quoted(DIGITS)}"))
    patterns = {k: v[:2] for k, v in BASE.items()} | {k: v[:2] for k, v in LOOSE.items()}
    df = df.select(*kept, *[matches("t", p, w).alias(f"p_{k}") for k, (p, w) in patterns.items()])
    df = df.select(*kept, *[(_checked(k) if k in BASE else F.col(f"p_{k}")).alias(f"c_{k}") for k in KINDS])
    return df.select(*kept, F.concat(*[_voted(k) for k in KINDS]).alias("cands"))


def reliabilities(counts: dict[tuple[int, int, int, int, int], int], rounds: int = 100) -> tuple[np.ndarray, np.ndarray, dict]:
    """EM on counts by (kind, r, g, c, length): share of true spans per kind, P(vote | true, false) per labeler, and each
    pattern's posterior.

    A weak prior (one span of each sort) keeps the labelers better than chance at the start.
    """
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    kind = np.array([k[0] for k in keys], int)
    votes = np.array([k[1:4] for k in keys], float).reshape(-1, 3)
    share = np.full(len(KINDS), 0.5)
    hit = np.array([[0.9, 0.2], [0.7, 0.3], [0.5, 0.1]])  # rows: labelers; columns: true, false
    posterior = np.full(len(keys), 0.5)
    for _ in range(rounds):
        side = [np.prod(np.where(votes > 0, hit[:, j], 1 - hit[:, j]), axis=1) for j in (0, 1)]
        yes, no = share[kind] * side[0], (1 - share[kind]) * side[1]
        posterior = yes / np.maximum(yes + no, 1e-300)
        share = (np.bincount(kind, weights=n * posterior, minlength=len(KINDS)) + 1) / (np.bincount(kind, weights=n, minlength=len(KINDS)) + 2)
        for j, w in ((0, posterior), (1, 1 - posterior)):
            hit[:, j] = ((n * w) @ votes + np.array([0.9, 0.7, 0.5] if j == 0 else [0.2, 0.3, 0.1])) / ((n * w).sum() + 1)
        hit = np.clip(hit, 0.01, 0.99)
    return share, hit, dict(zip(keys, posterior.tolist(), strict=True))


def span_classifier(counts: dict[tuple, int], posterior: dict[tuple, float], rounds: int = 300, ridge: float = 1e-3) -> np.ndarray:
    """Weights of the logistic classifier: kinds, r, g, c, length classes; trained on the posteriors by Newton's method."""
    keys = sorted(counts)
    width = len(KINDS) + 3 + len(LENGTHS) + 1
    x = np.zeros((len(keys), width))
    for i, (k, r, g, c, length) in enumerate(keys):
        x[i, k] = 1
        x[i, len(KINDS) : len(KINDS) + 3] = r, g, c
        x[i, len(KINDS) + 3 + length] = 1
    n = np.array([counts[k] for k in keys], float)
    n /= max(1.0, n.sum())
    y = np.array([posterior[k] for k in keys])
    w = np.zeros(width)
    for _ in range(rounds if len(keys) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(width), x.T @ (n * (p - y)) + ridge * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(cands: DataFrame) -> np.ndarray:
    """Classifier weights from the votes of a whole table of candidates."""
    rows = cands.select(F.explode("cands").alias("x")).groupBy("x.k", "x.r", "x.g", "x.c", "x.l").count().collect()  # at most kinds x 8 x 4
    counts = {(r["k"], r["r"], r["g"], r["c"], r["l"]): r["count"] for r in rows}
    _, _, posterior = reliabilities(counts)
    return span_classifier(counts, posterior)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: np.ndarray | None = None, keep_text: bool = True) -> DataFrame:
    """id, t (the whole text, if wished) and spans: array of (k, s, e), base spans, and the looser ones that the classifier
    takes and that touch no base span.

    k is the place in KINDS; spans are ordered by kind, then place. Trains on docs unless weights are given.
    """
    cands = candidates(docs, id_col, text_col, keep_text)
    if weights is None:
        cands = saved(cands, "candidates")
    w = train(cands) if weights is None else weights
    kinds = "array(" + ", ".join(f"{x!r}D" for x in w[: len(KINDS)].tolist()) + ")"
    lengths = "array(" + ", ".join(f"{x!r}D" for x in w[len(KINDS) + 3 :].tolist()) + ")"
    r, g, c = (f"{x!r}D" for x in w[len(KINDS) : len(KINDS) + 3].tolist())
    taken = f"x -> x.k >= {len(BASE)} AND element_at({kinds}, x.k + 1) + {r} * x.r + {g} * x.g + {c} * x.c + element_at({lengths}, x.l + 1) >= 0"
    short = "x -> named_struct('k', x.k, 's', x.s, 'e', x.e)"
    base = f"transform(filter(cands, x -> x.k < {len(BASE)}), {short})"
    both = cands.withColumns({"base": F.expr(base), "more": F.expr(f"transform(filter(cands, {taken}), {short})")})
    return both.select("id", *(["t"] if keep_text else []), F.expr(f"concat(base, {apart('more', 'base')})").alias("spans"))


def listed(spans: str) -> str:
    """SQL: kind:start:end of the spans, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, x -> concat(element_at({names}, x.k + 1), ':', x.s, ':', x.e)), ',')"


def masked() -> Column:
    """The text t with each of its spans replaced by its kind in brackets; overlapping spans become one mask, by the kind of the
    first, or of the longest of those that begin together."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    first = "transform(spans, x -> named_struct('s', x.s, 'm', -x.e, 'k', x.k, 'e', x.e))"
    return F.expr(f"CASE WHEN size(spans) = 0 THEN t ELSE {replaced('t', first, f'concat({chr(39)}[{chr(39)}, element_at({names}, {{x}}.k + 1), {chr(39)}]{chr(39)})')} END")
