"""How filters of documents interact: every order of five filters, replayed document by document."""

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..checkpoints import stored, written

#: Fixed by the contract of the audit: words, and the characters that fail filter D.
WORD_GAPS, SYMBOLS = "[ \\t-\\r]+", "[#$%&*|]"


def base_flags(text: Column) -> dict[str, Column]:
    """Failure of the filters that look at one text alone; a null text counts as empty.

    A: under 200 words. B: under half of the words are distinct. C: over a fiftieth of the
    characters are capitals of A-Z. D: holds one of #$%&*|.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, WORD_GAPS), "")
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def document_flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, A, B, C, D, E) for each row of `docs`; E: a row of a smaller id has the same text.

    Texts are read once: flags and a SHA-256 of the text are written, and copies are found
    among the digests. The least id of each text that several rows have comes from a partial
    aggregate, which is stored, so that both sides of the join are plain exchanges and Spark
    can split a text with very many copies. A null text counts as empty and a null part as
    ''; rows without an id fail E never, nor make others fail it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    told = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *(flag.alias(name) for name, flag in base_flags(text).items()))
    told = written(told)
    least = stored(told.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("digest", "least"))
    return told.join(least, "digest", "left").withColumn("E", F.coalesce(F.col("id") > F.col("least"), F.lit(False))).drop("digest", "least")


def with_labels(flags: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`flags` with `good` (a label says quality 1) and `toxic` (a label says toxic 1), both false without a label."""
    told = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    found = flags.join(stored(told), "id", "left")
    return found.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def filter_audit(flags: DataFrame, names: str = "ABCDE") -> DataFrame:
    """What each filter does at each step of each order, by part; one row for each (part, filter_order, step), zeros included.

    flags: (part, good, toxic and one boolean column a filter, named as in `names`). Each
    row meets all orders of the filters, a fixed table that is broadcast; the first step
    whose filter fails the row follows from the filters' places in the order, and every step
    of every order is a row of the aggregate, which is summed where it is made before
    anything is shuffled. Counts of documents in the part: kept after the step, removed by
    it, redundant (fails its filter, removed before), unique_fails (fails its filter alone),
    good_lost and toxic_lost (removed by it), shapley (removed by its filter, over all
    orders). An empty table gives an empty result.
    """
    spark, n = flags.sparkSession, len(names)
    orders = spark.createDataFrame([("".join(p), [1 << names.index(x) for x in p]) for p in permutations(names)], "filter_order string, _bits array<int>")
    orders = orders.select("*", *(F.instr("filter_order", x).alias(f"_at_{x}") for x in names))
    mask = sum(F.col(x).cast("int") * (1 << k) for k, x in enumerate(names))
    failed = [F.when(F.col("_mask").bitwiseAND(F.lit(1 << k)) != 0, F.col(f"_at_{x}")) for k, x in enumerate(names)]
    crossed = flags.select("part", "good", "toxic", mask.alias("_mask")).crossJoin(F.broadcast(orders)).withColumn("_first", F.coalesce(F.least(*failed), F.lit(n + 1)))
    steps = crossed.select("part", "filter_order", "good", "toxic", "_mask", "_first", F.posexplode("_bits").alias("_at", "_bit")).withColumn("step", F.col("_at") + 1)
    fails = F.col("_mask").bitwiseAND(F.col("_bit")) != 0
    here = F.col("_first") == F.col("step")
    counted = {
        "kept": F.col("_first") > F.col("step"),
        "removed": here,
        "redundant": fails & (F.col("_first") < F.col("step")),
        "unique_fails": F.col("_mask") == F.col("_bit"),
        "good_lost": here & F.col("good"),
        "toxic_lost": here & F.col("toxic"),
    }
    told = steps.groupBy("part", "filter_order", "step").agg(*(F.sum(c.cast("bigint")).alias(name) for name, c in counted.items()))
    told = told.withColumn("_filter", F.expr("substring(filter_order, step, 1)"))
    # Of the counts alone: 120 rows for each part and filter.
    share = F.sum("removed").over(Window.partitionBy("part", "_filter"))
    return told.select("part", "filter_order", "step", *counted, share.alias("shapley"))
