"""Quality rules: a threshold table compiled into one Spark projection of ratios, with no user function."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, table, unused

STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was were with "
    "au aux avec dans de des du elle en est et la le les par pas pour que qui sur un une "
    "als auf das dem den der des die ein eine er für im ist mit nicht sich sie und von zu "
    "al como con del el es esta la las lo los más no para por que se su un una y"
).split()
SYMBOLS = "#*%$&|@^~<>{}[]\\=_+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÚÛÜ"


@dataclass(frozen=True)
class Rule:
    """Bounds of a metric, for texts of at least so many words."""

    metric: str
    low: float | None = None
    high: float | None = None
    words: int = 0


#: A document is kept if each metric lies within its bounds (inclusive). Ratios of nothing are 0. Texts of under 20 words
#: may lack stop words or have short words only.
RULES = (
    Rule("n_words", low=1),
    Rule("mean_word_length", high=20.0),
    Rule("mean_word_length", low=2.5, words=20),
    Rule("symbol_ratio", high=0.05),
    Rule("upper_ratio", high=0.40),
    Rule("exclamation_ratio", high=0.04),
    Rule("stop_word_ratio", low=0.05, words=20),
    Rule("repeated_word_ratio", high=0.20),
    Rule("repeated_line_ratio", high=0.4),
    Rule("bullet_line_ratio", high=0.9),
    Rule("ellipsis_line_ratio", high=0.3),
)


def _without(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def metrics(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """words: the words in lower case; lines: those with something in them."""
    n_words, n_lines, n_chars = F.size(words), F.size(lines), F.length(text)
    of_lines = lambda test: _ratio(F.size(F.filter(lines, test)), n_lines)
    return {
        "n_words": n_words.cast("long"),
        "mean_word_length": _ratio(F.length(F.translate(text, " \t\n\r\f", "")), n_words),
        "symbol_ratio": _ratio(_without(text, SYMBOLS), n_chars),
        "upper_ratio": _ratio(_without(text, UPPER), n_chars),
        "exclamation_ratio": _ratio(_without(text, "!"), n_chars),
        "stop_word_ratio": _ratio(F.size(F.filter(words, lambda w: w.isin(sorted(set(STOP_WORDS))))), n_words),
        "repeated_word_ratio": _ratio(F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1)))), n_words),
        "repeated_line_ratio": _ratio(n_lines - F.size(F.array_distinct(lines)), n_lines),
        "bullet_line_ratio": of_lines(lambda x: x.startswith("- ") | x.startswith("* ") | x.startswith("• ")),
        "ellipsis_line_ratio": of_lines(lambda x: x.endswith("...") | x.endswith("…")),
    }


def once(x: Column) -> Column:
    return F.explode(F.array(x))


def scored(docs: DataFrame, rules=RULES, text: str = "text", measured: str = "_metrics", keep_: str = "_keep") -> DataFrame:
    """All columns, with the struct `measured`, and `keep_` compiled from the table; columns of these two names are replaced.

    A null text counts as an empty one: all its metrics are 0, and it fails `n_words`.
    """
    t = F.coalesce(col(text), F.lit(""))
    words = F.filter(F.split(F.lower(t), "[ \t\n\r\f]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x != "")
    # A generator of one row holds what is computed: the optimizer would copy plain projections into each rule.
    (held,) = unused([*docs.columns, measured, keep_], "_parts")
    parts = docs.withColumn(held, once(F.struct(t.alias("t"), words.alias("w"), lines.alias("l"))))
    every = metrics(col(held)["t"], col(held)["w"], col(held)["l"])
    out = parts.withColumn(measured, once(F.struct(*[c.alias(n) for n, c in every.items()])))
    keep = F.lit(True)
    for r in rules:
        if r.metric not in every:
            raise ValueError(f"no metric {r.metric}; there are {', '.join(every)}")
        value = col(measured)[r.metric]
        within = (F.lit(True) if r.low is None else value >= r.low) & (F.lit(True) if r.high is None else value <= r.high)
        keep = keep & (within | (col(measured)["n_words"] < r.words) if r.words else within)
    return out.withColumn(keep_, keep).drop(held)


def keep_good(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The rows within all thresholds, with their own columns and no others. Rows that are equal fare alike."""
    measured, keep = unused(docs.columns, "_metrics", "_keep")
    return scored(docs, rules, text, measured, keep).where(col(keep)).select(*map(col, docs.columns))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document that is kept, with its metrics (ratios to 6 places)."""
    x = scored(table(spark, sf_dir, "documents").select("doc_id", "text")).where("_keep")
    names = [f.name for f in x.schema["_metrics"].dataType.fields]
    return x.select("doc_id", *[F.round(F.col("_metrics")[n], 6).alias(n) if n != "n_words" else F.col("_metrics")[n].alias(n) for n in names])


def _sql(rules=RULES) -> str:
    q = lambda s: s.replace("'", "''")
    less = lambda s: f"length(t) - length(translate(t, '{q(s)}', ''))"
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b})::DOUBLE ELSE 0.0::DOUBLE END"
    lines = lambda test: ratio(f"len(list_filter(ls, lambda x: {test}))", "len(ls)")
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    every = {
        "n_words": "len(ws)::BIGINT",
        "mean_word_length": ratio("length(regexp_replace(t, '[ \\t\\n\\r\\f]', '', 'g'))", "len(ws)"),
        "symbol_ratio": ratio(less(SYMBOLS), "length(t)"),
        "upper_ratio": ratio(less(UPPER), "length(t)"),
        "exclamation_ratio": ratio(less("!"), "length(t)"),
        "stop_word_ratio": ratio(f"len(list_filter(ws, lambda x: x IN ({stop})))", "len(ws)"),
        "repeated_word_ratio": ratio("len(list_filter(ws, lambda x, i: i > 1 AND x = ws[i - 1]))", "len(ws)"),
        "repeated_line_ratio": ratio("len(ls) - len(list_distinct(ls))", "len(ls)"),
        "bullet_line_ratio": lines("starts_with(x, '- ') OR starts_with(x, '* ') OR starts_with(x, '• ')"),
        "ellipsis_line_ratio": lines("ends_with(x, '...') OR ends_with(x, '…')"),
    }
    short = lambda r, test: f"(n_words < {r.words} OR {test})" if r.words else test
    bounds = " AND ".join(short(r, f"{r.metric} {op} {v}") for r in rules for op, v in ((">=", r.low), ("<=", r.high)) if v is not None)
    shown = ", ".join(n if n == "n_words" else f"round({n}, 6) AS {n}" for n in every)
    return f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, t, list_filter(regexp_split_to_array(lower(t), '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: x <> '') AS ls FROM a),
c AS (SELECT doc_id, {', '.join(f'{e} AS {n}' for n, e in every.items())} FROM b)
SELECT doc_id, {shown} FROM c WHERE {bounds}
"""


QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLES = {"op3_quality_rules": _sql()}
