"""An inventory derived from the driver's tables, by expressions that SQL has too."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatum.functions import derive
from estatum.scratch import stored

ROOTS = ("/Users/ana", "/Volumes/Level 1", "/Volumes/Level 1w", "/Volumes/Level 2", "/Volumes/Level_3a", "/Volumes/DropboxStorage/Dropbox", "/Volumes/Backup", "/Volumes/NFS-Backup")
FOLDERS = {"en": "Documents", "de": "Photos", "fr": "Music", "es": "src"}
ENDS = (".txt", ".PDF", ".jpg", "", ".mp3", ".tar.gz")
DOMAINS = [("photos", ["/photos/", "/dcim/"]), ("music", ["/music/"]), ("documents", ["/documents/"]), ("code", ["/src/"])]
CLUSTERS = [("Level-Two", ["^/Volumes/Level 2/"]), ("Numbered-Five", ["/[0-9]*5\\.", "/[0-9]*5$"])]
HOME = "/Users/ana"
NOW = "2024-06-01 00:00:00"


def _permanodes(claims: DataFrame) -> DataFrame:
    return claims.groupBy("permanode_id").agg(F.min("canonical_hash").alias("canonical_hash"), F.min("size_bytes").alias("size_bytes"), F.min("observed_at").alias("first_seen_at"), F.max("observed_at").alias("last_seen_at"))


@dataclass(frozen=True)
class Estate:
    """The tables of one folder, made when asked for."""

    spark: SparkSession
    folder: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def now(self):
        return F.lit(NOW).cast("timestamp")

    @cached_property
    def claims(self) -> DataFrame:
        """One claim a document; paths by its source and language."""
        d = self.read("documents")
        pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
        folder = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv]), F.col("lang")), F.lit("misc"))
        root = pick(ROOTS, F.substring("source", 4, 9).cast("int") % 8)
        path = F.concat(root, F.lit("/"), folder, F.lit("/"), F.col("doc_id").cast("string"), pick(ENDS, F.col("doc_id") % 6))
        hashed, size = F.sha2("text", 256), F.octet_length("text").cast("long")
        rows = d.select(
            F.col("doc_id").alias("claim_id"), derive.permanode_id(hashed, size).alias("permanode_id"), hashed.alias("canonical_hash"),
            F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("machine_id"), path.alias("file_path"), size.alias("size_bytes"),
            (F.col("doc_id") % 4 + 1).alias("scan_run_id"), (F.col("doc_id") % 10 != 9).alias("is_current"),
            F.when(F.col("doc_id") % 17 == 0, F.lit("/Volumes/Level 2/a.zip")).alias("container_path"),
            F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("observed_at"),
            F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id") * 7).alias("mtime"),
            F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("classification"),
        )
        file = F.col("file_path")
        out = rows.withColumns({"tier": derive.tier(file), "volume": derive.volume(file), "extension": derive.extension(file)})
        return derive.classify(out, DOMAINS, CLUSTERS)

    @cached_property
    def kept_claims(self) -> DataFrame:
        """The claims as a table, as an inventory has them: tier and labels are columns,
        not rules to be worked out at each use."""
        return stored(self.claims, "claims")

    @cached_property
    def kept_permanodes(self) -> DataFrame:
        return _permanodes(self.kept_claims)

    @cached_property
    def permanodes(self) -> DataFrame:
        return _permanodes(self.claims)

    @cached_property
    def line_claims(self) -> DataFrame:
        """Sightings by order line; the same path is seen more than once."""
        li, prefix = self.read("lineitem"), F.get(F.array(*map(F.lit, ROOTS)), (F.col("l_suppkey") % 8).cast("int"))
        end = F.when(F.col("l_returnflag") == "A", ".jpg").when(F.col("l_returnflag") == "N", ".txt").otherwise(".mp3")
        path = F.concat(prefix, F.lit("/"), F.year("l_shipdate").cast("string"), F.lit("/"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), end)
        size = F.col("l_quantity").cast("long")
        rows = li.select(F.col("l_partkey").cast("string").alias("permanode_id"), path.alias("file_path"), size.alias("size_bytes"), F.concat(F.lit("m"), (F.col("l_suppkey") % 3).cast("string")).alias("machine_id"), F.lit(None).cast("string").alias("container_path"), F.datediff("l_shipdate", F.lit("1970-01-01").cast("date")).cast("long").alias("scan_run_id"), (F.col("l_extendedprice") * 100).cast("long").alias("claim_id"), F.col("l_shipdate").cast("timestamp").alias("observed_at"), F.lit(True).alias("is_current"))
        return rows.withColumns({"tier": derive.tier(F.col("file_path")), "volume": derive.volume(F.col("file_path"))})

    @cached_property
    def runs(self) -> DataFrame:
        o = self.read("orders")
        start = F.col("o_orderdate").cast("timestamp")
        return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("/Volumes/"), F.col("o_orderpriority")).alias("root_path"), F.concat(F.lit("m"), (F.col("o_custkey") % 3).cast("string")).alias("machine_id"), start.alias("started_at"), F.when(F.col("o_orderstatus") != "O", start + F.make_dt_interval(hours=F.lit(2))).alias("finished_at"))

    @cached_property
    def events(self) -> DataFrame:
        """A log: one machine in 50 users, stash life cycles by event type."""
        e = self.read("events")
        k = F.get_json_object("props", "$.k")
        action = F.when(F.col("event_type") == "purchase", "stash_committed").when(F.col("event_type") == "signup", "stash_finalized").when(F.col("event_type") == "error", "stash_restored").when(F.col("event_type") == "click", "replicate_end").otherwise("archive_end")
        return e.select(F.col("event_id").alias("id"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("machine_id"), action.alias("action"), F.concat(F.lit("run"), (F.col("user_id") % 20).cast("string")).alias("manifest_run_id"), F.concat(F.lit('{"source":"/s/'), k, F.lit('","destination":"/d/'), k, F.lit('"}')).alias("payload"), F.col("ts").cast("timestamp").alias("timestamp"), F.lit(None).cast("string").alias("permanode_id"), F.col("value"))

    @cached_property
    def chain(self) -> DataFrame:
        """The log with hashes: each row's link is a digest of the row before it, and
        every 997th row was tampered with."""
        body = F.concat_ws(":", F.col("id").cast("string"), "action", "payload")
        return self.events.withColumn("body", body).withColumn("row_hash", F.sha2(F.concat("body", F.when(F.col("id") % 997 == 996, "x").otherwise("")), 256))

    @cached_property
    def store(self) -> DataFrame:
        rel = derive.cloud_relative(F.col("file_path"), HOME)
        return self.claims.filter(rel.isNotNull() & (F.col("claim_id") % 5 != 0)).select(rel.alias("relative"))

    @cached_property
    def mount(self) -> DataFrame:
        rel = derive.cloud_relative(F.col("file_path"), HOME)
        return self.claims.filter(rel.isNotNull() & (F.col("claim_id") % 7 != 0)).select(rel.alias("relative"), (F.col("claim_id") % 11 == 0).alias("error"))

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.read("embeddings").select(F.col("vec_id").cast("string").alias("permanode_id"), F.lit("m").alias("model_name"), F.col("label").cast("string").alias("model_version"), F.col("embedding").alias("vector"), F.col("vec_id"))


