"""Commands that differ only in formatting, collapsed with their number of copies.

The columns are dictionary-encoded. Distinct raw commands are counted first, so that a command
run a billion times is one row from then on. Each command falls into fields: leading settings,
options with their values, and other words. Every distinct raw field is canonicalised once and
given an integer; commands become short integer tuples, settings and options sorted, and the
tuples are grouped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.cut import Cutter

DASHES = r"\-‐-―−"
HOT = 4096  # a field of more than one in so many rows is frequent
BUCKETS = 1024  # ranges of dictionary integers that are numbered independently


#: A setting before the command; an option with what it holds after "=", or else with the next word unless that is an option itself.
SETTINGS = r"^((?:[\p{L}_][\p{L}\p{N}_]*=[^ ]*(?: |$))*)"
OPTION = rf"(?<= )[{DASHES}](?:[^ =]*=[^ ]*|[^ =]+(?=\s|$)(?: (?![{DASHES}])[^ ]+)?)"


def with_fields(commands: DataFrame) -> DataFrame:
    """(rec, n, fields) of rows (rec, n, command); a field is (kind, raw), kind 0 setting, 1 the words in order, 2 option.

    Plain regular expressions over the whole command: all of it stays in generated code.
    """
    line = F.regexp_replace(F.lower("command"), r"(?U)\s+", " ")
    line = F.regexp_replace(line, rf"(?<![^ ])[^\p{{L}}\p{{N}}{DASHES} ]+(?=[\p{{L}}\p{{N}}{DASHES}])", "")  # quotes and the like before a word
    line = F.trim(F.regexp_replace(line, r"(?<![^ ])[^\p{L}\p{N} ]+(?![^ ])", ""))  # words without letter or digit
    line = F.regexp_replace(line, " +", " ")
    split = commands.select("rec", "n", line.alias("line")).withColumn("head", F.regexp_extract("line", SETTINGS, 1))
    split = split.withColumn("rest", F.concat(F.lit(" "), F.expr("substring(line, length(head) + 1)")))
    words = F.trim(F.regexp_replace(F.regexp_replace("rest", OPTION, ""), r"[^\p{L}\p{N}]+", " "))
    split = split.select("rec", "n", F.split(F.trim("head"), " ").alias("head"), F.regexp_extract_all("rest", F.lit(OPTION), F.lit(0)).alias("options"), words.alias("words"))
    field = lambda kind: lambda raw: F.struct(F.lit(kind).alias("kind"), raw.alias("raw"))
    present = lambda c: F.filter(c, lambda x: x != "")
    return split.select(
        "rec", "n",
        F.concat(
            F.transform(present("head"), field(0)),
            F.transform(F.array("words"), field(1)),
            F.transform(present("options"), field(2)),
        ).alias("fields"),
    )


def dictionary(raw: DataFrame) -> DataFrame:
    """(raw, n, code): the number of rows of each raw field, and a code; equal codes if and only if the canonical forms are equal.

    A code is a bucket, from the form's hash, and the form's rank in it: no global order is
    needed and a recomputed task gives the same codes.
    """
    canon = F.trim(F.regexp_replace("raw", r"[^\p{L}\p{N}]+", " "))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy("canon"))
    return (
        raw.groupBy("raw").agg(F.count(F.lit(1)).alias("n")).withColumn("canon", canon)
        .withColumn("bucket", F.pmod(F.xxhash64("canon"), F.lit(BUCKETS)))
        .select("raw", "n", (F.col("bucket") * F.lit(1 << 40) + rank).alias("code"))
    )


def collapse_formatting(rows: DataFrame, key: str, command: str) -> DataFrame:
    """(rep_id, n_copies, n_notations) of every group of commands that are the same.

    rep_id is the smallest key, n_copies counts rows, n_notations distinct raw texts. Case is
    ignored and any run of other characters than letters and digits separates like one space;
    leading NAME=value settings and options with their values may stand in any order. An option
    takes the next word as its value unless it holds one after "=" or the next is an option
    itself. Null commands give no row; commands without any letter or digit form one group.

    Exact repeats are counted before anything else is shuffled, and groups are summed map-side,
    so a command that holds a third of the rows never meets in one task. The distinct commands'
    fields are written once to the shared checkpoint folder and read twice. A field that holds
    more than one in HOT rows gets its code from a broadcast: there are fewer than HOT such fields,
    each of at most 1,000 characters, so its size is bounded whatever the data; all other fields
    are joined by shuffle, and none of them is frequent.
    """
    raw = rows.select(F.col(key).alias("rec"), F.col(command).alias("command")).where(F.col("command").isNotNull())
    raw = raw.groupBy("command").agg(F.min("rec").alias("rec"), F.count(F.lit(1)).alias("n"))
    fields = with_fields(raw).select("rec", "n", F.explode("fields").alias("f")).select("rec", "n", "f.kind", "f.raw")
    cutter = Cutter(rows.sparkSession, "formatdup")
    fields = cutter.cut(fields)  # read for the dictionary and for the tuples
    codes = cutter.cut(dictionary(fields))
    total = codes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = (F.col("n") * HOT > total) & (F.length("raw") <= 1000)
    hot = F.broadcast(codes.where(frequent).select("raw", F.col("code").alias("hot")))
    marked = fields.join(hot, "raw", "left")
    rare = marked.where("hot is null").join(codes.where(~frequent).select("raw", "code"), "raw")
    coded = marked.where("hot is not null").withColumnRenamed("hot", "code").unionByName(rare.drop("hot")).select("rec", "n", F.struct("kind", "code").alias("e"))
    tuples = coded.groupBy("rec").agg(F.first("n").alias("n"), F.sort_array(F.collect_list("e")).alias("es"))
    return tuples.groupBy("es").agg(F.min("rec").alias("rep_id"), F.sum("n").alias("n_copies"), F.count(F.lit(1)).alias("n_notations")).drop("es")
