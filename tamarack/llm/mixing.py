"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by a hash and laid end to end; every BLOCK_TOKENS tokens a new block begins, so
that blocks are equal however long the documents are, and a document belongs to the block in which it starts. Slot i of
the schedule maps the golden-ratio point frac((i + 1) * 0.618...) through the cumulative weights to a source. The slot
of rank r within its source takes block r modulo the source's blocks; r divided by them is the epoch. All of it is
relational: ranks are running counts over buckets of slots, and slots meet blocks in an equi-join.

There are as many slots as every block needs to come at least once: no document is lost, and a source that is small for
its weight comes again in further epochs. Without given weights every source counts as one block at least, also one
whose texts are all null or blank; so the slots are never more than a few times the blocks.

The points are integers modulo 2**53, exact for 2**36 slots (10**14 tokens).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, materialize, md5_bucket, row_digest, running_sum, table, unused, word_count

BLOCK_TOKENS = 2048
#: Without given weights, a source's weight is its share of tokens to this power: below 1, small sources come more often.
TEMPERATURE = 0.8
#: The golden ratio's fraction times 2**53, in a part of 27 bits and one of 26.
GOLDEN = 5566755282872655
GOLDEN_HIGH, GOLDEN_LOW = GOLDEN >> 26, GOLDEN & (1 << 26) - 1
SLOT_BUCKET = 1 << 16
CELLS = 4096
SEED = "mix"


def _source(source):
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _blocks(units: DataFrame, block_tokens: int) -> DataFrame:
    """(_source, _digest, _block) of each unit (_source, _digest, _n)."""
    placed = running_sum(units.withColumn("_bucket", md5_bucket(F.col("_digest"), 3)), ["_source"], "_bucket", [F.col("_digest")], F.col("_n"), "_start")
    return placed.select("_source", "_digest", F.floor(F.col("_start") / F.lit(block_tokens)).cast("long").alias("_block"))


def _slots(sources: DataFrame, slots: int) -> DataFrame:
    """(_slot, _source, _rank) from (_source, _lo, _hi), the ranges of the sources in [0, 1)."""
    spark = sources.sparkSession
    cells = sources.where("_hi > _lo").withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") * CELLS), F.least(F.floor(F.col("_hi") * CELLS), F.lit(CELLS - 1)))))
    i = F.col("id") + 1
    x = (i * F.lit(GOLDEN_LOW) + (i * F.lit(GOLDEN_HIGH)) % F.lit(1 << 27) * F.lit(1 << 26)) % F.lit(1 << 53)
    points = spark.range(slots).select(F.col("id").alias("_slot"), (x.cast("double") / F.lit(float(1 << 53))).alias("_x")).withColumn("_cell", F.floor(F.col("_x") * CELLS))
    hit = points.join(cells, "_cell").where("_x >= _lo and _x < _hi").select("_slot", "_source")
    bucketed = hit.withColumn("_bucket", F.floor(F.col("_slot") / F.lit(SLOT_BUCKET)))
    return running_sum(bucketed, ["_source"], "_bucket", [F.col("_slot")], F.lit(1), "_rank").select("_slot", "_source", "_rank")


def scheduled(docs: DataFrame, weights: dict | None = None, block_tokens: int = BLOCK_TOKENS, temperature: float = TEMPERATURE, slots: int | None = None, id_: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(_source, _digest, _slot, _epoch): the slots of each distinct row, told by its digest.

    Rows equal in id, source and text go together. A null source is a source of its own (`None` in `weights`); sources
    that `weights` lacks, or gives 0, get no slot. A null or empty text has no tokens and goes where it falls. With a
    given number of `slots`, blocks of higher ranks are left out.
    """
    spark = docs.sparkSession
    rows = docs.select(_source(col(source)).alias("_source"), digest_of(id_, text, source).alias("_digest"), word_count(col(text)).alias("_n"))
    units = materialize(rows.groupBy("_source", "_digest").agg(F.sum("_n").alias("_n")))
    blocks = materialize(_blocks(units, block_tokens))
    per = blocks.groupBy("_source").agg((F.max("_block") + 1).alias("_blocks")).join(units.groupBy("_source").agg(F.sum("_n").alias("_tokens")), "_source")
    if weights is None:
        weighted = per.withColumn("_weight", F.pow(F.greatest(F.col("_tokens"), F.lit(block_tokens)).cast("double"), F.lit(float(temperature))))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        given = spark.createDataFrame([("null" if s is None else f"={s}", float(w)) for s, w in weights.items()], "_source string, _weight double")
        weighted = per.join(given, "_source").where("_weight > 0")
    every, up_to = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("_source")
    share = weighted.withColumn("_all", F.sum("_weight").over(every)).withColumn("_to", F.sum("_weight").over(up_to)).withColumn("_last", F.row_number().over(up_to) == F.count("*").over(every))
    share = share.where("_weight > 0").withColumn("_p", F.col("_weight") / F.col("_all")).withColumn("_hi", F.when(F.col("_last"), F.lit(1.0)).otherwise(F.col("_to") / F.col("_all")))
    ranged = materialize(share.withColumn("_lo", F.lag("_hi", 1, 0.0).over(up_to)).select("_source", "_blocks", "_p", "_lo", "_hi"))
    if slots is None:
        # The points of N slots miss a source's share by less than 2 + ln N, so every rank below _blocks occurs.
        slots = ranged.agg(F.max(F.ceil((F.col("_blocks") + 2 + F.log(F.col("_blocks") / F.col("_p") + 2)) / F.col("_p")))).first()[0] or 0
    taken = _slots(ranged, int(slots)).join(ranged.select("_source", "_blocks"), "_source")
    taken = taken.select("_source", "_slot", (F.col("_rank") % F.col("_blocks")).alias("_block"), F.floor(F.col("_rank") / F.col("_blocks")).alias("_epoch"))
    return blocks.join(taken, ["_source", "_block"]).select("_digest", "_slot", "_epoch")


def digest_of(id_: str, text: str, source: str):
    return row_digest(SEED, col(source), col(id_), F.md5(col(text)))


def mix(docs: DataFrame, weights: dict | None = None, **options) -> DataFrame:
    """The documents as the schedule has them: all columns, a row for each slot that takes the document's block."""
    names = {k: options.get(k, d) for k, d in (("id_", "doc_id"), ("text", "text"), ("source", "source"))}
    digest, of = unused(docs.columns, "_digest", "_of")
    plan = scheduled(docs, weights, **options).select(F.col("_digest").alias(of))
    return docs.withColumn(digest, digest_of(**names)).join(plan, col(digest) == col(of)).select(*map(col, docs.columns))


def op8_mix_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slot, doc_id, source, epoch): the whole schedule over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    plan = scheduled(docs)
    return docs.select("doc_id", "source", digest_of("doc_id", "text", "source").alias("_digest")).join(plan, "_digest").select(F.col("_slot").alias("slot"), "doc_id", "source", F.col("_epoch").alias("epoch"))


ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce('=' || source, 'null') AS src,
    md5('{SEED}/' || coalesce(source, '\\N') || '/' || coalesce(doc_id::VARCHAR, '\\N') || '/' || coalesce(md5(text), '\\N') || '/') AS dg,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) AS n FROM documents),
u AS (SELECT src, dg, sum(n)::BIGINT AS n FROM d GROUP BY ALL),
b AS (SELECT src, dg, n, (coalesce(sum(n) OVER (PARTITION BY src ORDER BY dg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // {BLOCK_TOKENS}) AS block FROM u),
w AS (SELECT src, max(block) + 1 AS blocks, pow(greatest(sum(n), {BLOCK_TOKENS})::DOUBLE, {TEMPERATURE}::DOUBLE) AS weight FROM b GROUP BY src),
p AS (SELECT src, blocks, weight / sum(weight) OVER () AS p, CASE WHEN row_number() OVER (ORDER BY src) = count(*) OVER () THEN 1 ELSE sum(weight) OVER (ORDER BY src) / sum(weight) OVER () END AS hi FROM w WHERE weight > 0),
r AS (SELECT *, lag(hi, 1, 0) OVER (ORDER BY src) AS lo FROM p),
t AS (SELECT max(ceil((blocks + 2 + ln(blocks / p + 2)) / p))::BIGINT AS slots FROM r),
x AS (SELECT i AS slot, (((i + 1) * {GOLDEN_LOW} + (i + 1) * {GOLDEN_HIGH} % {1 << 27} * {1 << 26}) % {1 << 53})::DOUBLE / {1 << 53}::DOUBLE AS y FROM t, range(slots) s(i)),
s AS (SELECT slot, src, blocks, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS rnk FROM x JOIN r ON y >= lo AND y < hi)
SELECT s.slot, d.doc_id, d.source, s.rnk // s.blocks AS epoch
FROM s JOIN b ON b.src = s.src AND b.block = s.rnk % s.blocks JOIN d ON d.dg = b.dg
"""

QUERIES = {"op8_mix_schedule": op8_mix_schedule}
ORACLES = {"op8_mix_schedule": ORACLE}
