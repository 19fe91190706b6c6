"""Personal data by weak supervision, in DataFrame expressions only.

Base spans are four patterns with checks; they always stay. Beyond them there are *candidates*:
strings that look like an address or a number without meeting a base pattern (``jo (at) site.org``,
``tel. 030 123 45 67``). Labelers vote on each candidate, +1, -1 or abstaining: patterns and check
sums, gazetteers (top-level domains, dialling and issuer prefixes), the words before it, its shape.

Nobody labelled the candidates. Expectation-maximisation estimates from the votes alone how
reliable each labeler is, and with that how probably each candidate is personal data. These
probabilities train the final span classifier, a logistic regression that also sees what no labeler
uses. Candidates that it is sure of and that overlap no base span are added.

Votes and features take few values, so training needs only counts of their combinations: one
aggregate with at most ``3 ** labelers * 2 ** features`` rows, whatever the corpus. It covers all
candidates. What the driver does with these counts is arithmetic on some hundred numbers.
"""

from collections.abc import Sequence
from functools import reduce
from math import exp, log
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")

# The base patterns, written so that Java's matcher finds the same spans in linear time and without
# recursion: possessive where giving back cannot help, and no start within a run that an earlier
# start would have taken. A card is a whole run of 13 to 19 digits, so shorter runs need no span.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text needs to have for a pattern to be worth a search.
_HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

# Candidates, by family.
FAMILIES = ("address", "number")
_CANDIDATES = {
    "address": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?(?:@|[(\[{]\x20?at\x20?[)\]}])\x20?[a-z0-9-]{1,63}+"
    r"(?:\x20?(?:\.|[(\[{]\x20?dot\x20?[)\]}])\x20?[a-z0-9-]{1,63}+){1,4}",
    "number": r"(?<![0-9A-Za-z+.,])\+?\(?[0-9](?:[().\x20/-]{0,3}[0-9]){6,18}(?![0-9A-Za-z])",
}
#: Code points before a candidate that its context is looked for in.
CONTEXT = 32
#: Probability above which the classifier adds a candidate.
SURE = 0.9

# Gazetteers and context words (fixed values).
_DOMAINS = "com|org|net|edu|gov|info|io|co|de|fr|es|it|uk|eu|at|ch|nl|be|pl|us|ca|au|jp|br|mx"
_DIALLING = r"^(?:\+|00)(?:1|7|2[0-9]|3[0-9]|4[0-9]|5[0-9]|6[0-9]|8[0-9]|9[0-9])|^\(?0[1-9]"
_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
_FOR = {
    "address": r"(?i)\b(?:e-?mail|mail|contact|write|reach|schreib|contacto|correo|courriel|adresse)\b",
    "number": r"(?i)\b(?:tel|telefon|telephone|phone|mobile|handy|cell|call|fax|whatsapp|card|visa|mastercard|karte|carte|tarjeta|contact|ssn|iban)\b",
}
_AGAINST = {
    "address": r"(?i)\b(?:version|regex|example|pattern)\b",
    "number": r"(?i)\b(?:version|page|isbn|issn|doi|invoice|order|chapter|figure|table|year|total|sum|id|no|nr)\b",
}

LABELERS = ("pattern", "gazetteer", "context", "shape")
FEATURES = ("long", "separated", "marked")


class Model(NamedTuple):
    """Weights of the span classifier of one family: bias, then each labeler for and against, then features."""

    bias: float
    weights: tuple[float, ...]


def _span_type(extra: str = "") -> str:
    return f"array<struct<start:int,end:int,match:string{extra}>>"


def _located(matches: Column, gaps: Column) -> Column:
    """Start and end (code points) of each match, from the lengths of what lies between."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_span_type()).alias("spans"))

    def step(done: Column, pair: Column) -> Column:
        start = done["at"] + F.char_length(pair["gap"])
        end = start + F.char_length(pair["match"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("match"))
        return F.struct(end.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(
        F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match"))
    )
    return F.aggregate(pairs, empty, step, lambda done: done["spans"])


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    backwards = F.reverse(_digits(match))

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(backwards, i, F.lit(1)).cast("int")
        doubled = F.when(i % 2 == 0, digit * 2).otherwise(digit)
        return total + F.when(doubled > 9, doubled - 9).otherwise(doubled)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(backwards))), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return _luhn(match)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _searched(df: DataFrame, name: str, pattern: str, hint: Column | None) -> DataFrame:
    """Column ``name``: the located matches of ``pattern`` in column ``_text``."""
    empty = F.array().cast("array<string>")
    wanted = F.lit(True) if hint is None else hint
    df = df.withColumn("_matches", F.when(wanted, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(empty))
    gaps = F.when(F.size("_matches") > 0, F.split("_text", pattern, -1)).otherwise(empty)
    df = df.withColumn("_gaps", gaps)
    found = F.when(F.size("_matches") > 0, _located(F.col("_matches"), F.col("_gaps"))).otherwise(F.array().cast(_span_type()))
    return df.withColumn(name, found).drop("_matches", "_gaps")


def with_base_spans(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with ``_text`` and, for each kind, an array ``_<kind>`` of spans with start, end and match."""
    df = df.withColumn("_text", F.coalesce(text, F.lit("")))
    for kind in KINDS:
        hint = F.contains("_text", F.lit(_HINTS[kind])) if _HINTS[kind] else None
        df = _searched(df, f"_{kind}", _PATTERNS[kind], hint)
        df = df.withColumn(f"_{kind}", F.filter(f"_{kind}", lambda s: _valid(kind, s["match"])))
    return df


def _vote(plus: Column, minus: Column) -> Column:
    return F.when(plus, 1).when(minus, -1).otherwise(0)


def _judge(family: str, text: Column, span: Column) -> Column:
    """The candidate with its votes, features and kind."""
    match = span["match"]
    # Two substrings: from the front to the candidate costs its position once.
    before = F.substring(text, F.greatest(F.lit(1), span["start"] - (CONTEXT - 1)), F.least(F.lit(CONTEXT), span["start"]))
    n = F.length(_digits(match))
    if family == "address":
        written_out = match.rlike(r"(?i)[(\[{]\x20?at")
        pattern = _vote(match.rlike("^" + _PATTERNS["email"].partition("))")[2] + "$"), match.rlike(r"\x20\."))
        known = match.rlike(rf"(?i)(?:\.|[)\]}}])\x20?(?:{_DOMAINS})$")
        gazetteer = _vote(known, ~known)
        shape = _vote(
            written_out & match.rlike(r"(?i)[(\[{]\x20?dot"), match.rlike(r"^[0-9.]+\x20?@|@[0-9.\x20]+$|\x20@\x20|\.\x20")
        )
        features = (F.length(match) > 24, match.rlike(r"\x20"), written_out)
        kind = F.lit("email")
    else:
        ip = _valid("ip", match)
        card = n.between(13, 19) & match.rlike(r"^[0-9](?:[\x20-]?[0-9])+$")
        phone = match.rlike(r"^\+[0-9][\x20().0-9-]+[0-9]$") & _valid("phone", match)
        sure = ip | phone | F.when(card, _luhn(match)).otherwise(False)
        pattern = _vote(sure, (card & ~sure) | ~n.between(9, 19))
        known = match.rlike(_DIALLING) & n.between(9, 15) | card & _digits(match).rlike(_ISSUERS)
        gazetteer = _vote(known | ip, ~known & ~ip)
        grouped = match.rlike(r"^\+?\(?[0-9]{1,5}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,6}\)?){1,5}$") & ~match.rlike(r"/.*\.|\..*/")
        dated = match.rlike(r"^[0-9]{1,4}[./\x20-][0-9]{1,2}[./\x20-][0-9]{1,4}$|^[0-9]+\.[0-9]+$|^[0-9]+(?:\x20/\x20?[0-9]+)+$")
        shape = _vote(grouped & ~dated & n.between(9, 19) | sure, dated | ~match.rlike(r"[^0-9]"))
        features = (n >= 13, match.rlike(r"[\x20().-]"), match.startswith("+"))
        kind = F.when(ip, "ip").when(card & ~phone, "card").otherwise("phone")
    context = _vote(before.rlike(_FOR[family]), before.rlike(_AGAINST[family]))
    votes = (pattern, gazetteer, context, shape)
    return F.struct(
        span["start"].alias("start"),
        span["end"].alias("end"),
        kind.alias("kind"),
        *[v.cast("int").alias(name) for name, v in zip(LABELERS, votes, strict=True)],
        *[f.cast("int").alias(name) for name, f in zip(FEATURES, features, strict=True)],
    )


def with_candidates(df: DataFrame) -> DataFrame:
    """``df`` with an array ``_address`` and ``_number`` of judged candidates of ``_text``."""
    hints = {
        "address": F.contains("_text", F.lit("@")) | F.col("_text").rlike(r"(?i)[(\[{]\x20?at\x20?[)\]}]"),
        "number": None,
    }
    for family in FAMILIES:
        df = _searched(df, "_found", _CANDIDATES[family], hints[family])
        judged = F.transform("_found", lambda s: _judge(family, F.col("_text"), s))
        df = df.withColumn(f"_{family}", judged).drop("_found")
    return df


def vote_counts(found: DataFrame, family: str) -> list[tuple[tuple[int, ...], tuple[int, ...], int]]:
    """``(votes, features, candidates)`` for each combination that occurs."""
    each = found.select(F.explode(f"_{family}").alias("c")).select("c.*")
    rows = each.groupBy(*LABELERS, *FEATURES).agg(F.count("*").alias("n")).collect()
    return [(tuple(r[c] for c in LABELERS), tuple(r[c] for c in FEATURES), r["n"]) for r in rows]


def _dot(xs: Sequence[float], ys: Sequence[float]) -> float:
    return sum(x * y for x, y in zip(xs, ys, strict=True))


def _logistic(x: float) -> float:
    return 1 / (1 + exp(-max(-30.0, min(30.0, x))))


def reliabilities(counts: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[dict], list[float]]:
    """EM over vote combinations: the share of personal data, each labeler's ``P(vote | class)`` by
    class, and the posterior of each combination. It starts from the majority of the votes."""
    posterior = [_logistic(1.5 * sum(votes) - 0.5) for votes, _ in counts]
    total = sum(n for _, n in counts)
    for _ in range(rounds):
        share = (sum(p * n for p, (_, n) in zip(posterior, counts, strict=True)) + 1) / (total + 2)
        tables = []
        for i in range(len(LABELERS)):
            table = {}
            for y in (0, 1):
                seen = {-1: 1.0, 0: 1.0, 1: 1.0}
                for p, (votes, n) in zip(posterior, counts, strict=True):
                    seen[votes[i]] += n * (p if y else 1 - p)
                whole = sum(seen.values())
                table |= {(vote, y): c / whole for vote, c in seen.items()}
            tables.append(table)
        posterior = [
            _logistic(
                log(share / (1 - share)) + sum(log(t[v, 1] / t[v, 0]) for t, v in zip(tables, votes, strict=True))
            )
            for votes, _ in counts
        ]
    return share, tables, posterior


def _inputs(votes: Sequence[int], features: Sequence[int]) -> list[float]:
    return [float(v > 0) for v in votes] + [float(v < 0) for v in votes] + [float(f) for f in features]


def fit(counts: list[tuple[tuple[int, ...], tuple[int, ...], int]], steps: int = 400, rate: float = 2.0) -> Model | None:
    """The span classifier for these counts, trained on the posteriors of the votes; None without any."""
    if not counts:
        return None
    by_votes: dict[tuple[int, ...], int] = {}
    for votes, _, n in counts:
        by_votes[votes] = by_votes.get(votes, 0) + n
    combinations = sorted(by_votes.items())
    _, _, posterior = reliabilities(combinations)
    believed = {votes: p for (votes, _), p in zip(combinations, posterior, strict=True)}
    rows = [(_inputs(votes, features), believed[votes], n) for votes, features, n in sorted(counts)]
    total = sum(n for _, _, n in rows)
    bias, weights = 0.0, [0.0] * (2 * len(LABELERS) + len(FEATURES))
    for _ in range(steps):
        errors = [(x, n * (_logistic(bias + _dot(weights, x)) - p)) for x, p, n in rows]
        bias -= rate * sum(e for _, e in errors) / total
        weights = [w - rate * (sum(e * x[j] for x, e in errors) / total + 1e-4 * w) for j, w in enumerate(weights)]
    return Model(bias, tuple(weights))


def train(found: DataFrame) -> dict[str, Model | None]:
    return {family: fit(vote_counts(found, family)) for family in FAMILIES}


def _score(model: Model, c: Column) -> Column:
    inputs = [(c[name] > 0).cast("double") for name in LABELERS] + [(c[name] < 0).cast("double") for name in LABELERS]
    inputs += [c[name].cast("double") for name in FEATURES]
    return reduce(lambda a, b: a + b, [F.lit(w) * x for w, x in zip(model.weights, inputs, strict=True)], F.lit(model.bias))


def _bare(kind: str) -> Column:
    return F.transform(
        f"_{kind}", lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    )


def with_all_spans(df: DataFrame, models: dict[str, Model | None]) -> DataFrame:
    """``df`` with ``_base`` and ``_spans``: arrays of ``(kind, start, end)`` by kind, then start."""
    df = df.withColumn("_base", F.concat(*[_bare(kind) for kind in KINDS]))
    added = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    for family, model in models.items():
        if model:
            sure = F.filter(f"_{family}", lambda c: _score(model, c) > log(SURE / (1 - SURE)))
            plain = F.transform(sure, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
            added = F.concat(added, plain)
    df = df.withColumn("_added", added)
    new = F.filter(
        "_added", lambda c: ~F.exists("_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    )
    df = df.withColumn("_new", F.array_sort(new, lambda a, b: (a["start"] - b["start"]).cast("int")))
    of_kind = [
        F.array_sort(
            F.concat(F.filter("_base", lambda s: s["kind"] == kind), F.filter("_new", lambda s: s["kind"] == kind)),
            lambda a, b: (a["start"] - b["start"]).cast("int"),
        )
        for kind in KINDS
    ]
    return df.withColumn("_spans", F.when(F.size("_new") == 0, F.col("_base")).otherwise(F.concat(*of_kind)))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_data(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` for each row of ``documents``.

    The counts and the hash are those of the base spans, ``spans`` lists all as ``kind:start:end``,
    positions in code points. A null text is an empty one, and an empty one has no spans. Repeated
    rows get equal results, ids may be null, other columns are ignored; an empty table gives an empty
    result. Without any candidate nothing is learnt and nothing added.
    """
    plain = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_source_text"))
    found = with_candidates(with_base_spans(plain, F.col("_source_text"))).select(
        "doc_id",
        *[F.transform(f"_{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(f"_{k}") for k in KINDS],
        *[f"_{family}" for family in FAMILIES],
    )
    found = written(found, "spans")
    return with_all_spans(found, train(found)).select(
        "doc_id",
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined("_base"), 256).alias("base_sha256"),
        _joined("_spans").alias("spans"),
    )


def masked_documents(documents: DataFrame) -> DataFrame:
    """``documents`` with every span of its texts replaced by ``<kind>``, all other columns kept.

    Overlapping spans become one mark, that of the earliest. ``n_chars``, where present, follows the
    text. Null texts stay null.
    """
    columns = documents.columns
    row = F.struct(*[documents[c] for c in columns]).alias("_row")
    found = with_candidates(with_base_spans(documents.select(row), F.col("_row.text")))
    models = train(written(found.select(*[f"_{family}" for family in FAMILIES]), "candidates"))
    marked = with_all_spans(found, models)
    order = F.array_sort("_spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]).cast("int"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    text = F.col("_text")

    def step(done: Column, s: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, s["start"] - done["at"])
        parts = F.when(s["start"] >= done["at"], F.concat(done["parts"], F.array(gap, F.concat(F.lit("<"), s["kind"], F.lit(">"))))).otherwise(done["parts"])
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), parts.alias("parts"))

    def finish(done: Column) -> Column:
        rest = F.substring(text, done["at"] + 1, F.lit(2**31 - 1))
        return F.array_join(F.concat(done["parts"], F.array(rest)), "")

    new = F.when(F.size("_spans") == 0, F.col("_row.text")).otherwise(F.aggregate(order, empty, step, finish))
    marked = marked.withColumn("_new_text", new)
    out = {c: F.col("_row")[c] for c in columns} | {"text": F.col("_new_text")}
    if "n_chars" in columns:
        changed = F.size("_spans") > 0
        kind = documents.schema["n_chars"].dataType
        out["n_chars"] = F.when(changed, F.char_length("_new_text").cast(kind)).otherwise(F.col("_row.n_chars"))
    return marked.select(*[value.alias(c) for c, value in out.items()])
