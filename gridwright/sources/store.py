"""Analyses, decisions and publications as versioned Parquet tables; the latest row of a key wins.

A write is a batch over one or several tables. Its rows are written to a folder that nobody reads
yet; then one small file in `commits` makes all of them the next version at once. A writer that
fails before that leaves nothing but a folder without a commit. Two writers can't make the same
version: the file is only ever created, and the later one takes the next number. Readers list the
commits, and may ask for any version. `compacted` writes a table's current rows as one batch that
replaces those before it, so that reading doesn't slow down as batches come; older versions can
still be read.

Defined cases. A table that no commit names is an error; an empty batch is a version. Of rows of
one batch with one key any may win, so keys are for the caller to make single. A deletion is a
row; null keys are keys.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer has made this version."""


class Store:
    """Tables under one folder, of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._file = lambda name: hadoop.Path(f"{self.path}/{name}")
        self._fs = self._file("commits").getFileSystem(spark._jsc.hadoopConfiguration())

    def _commits(self) -> dict[int, dict]:
        """The versions and what they hold. A commit that its writer didn't finish isn't one."""
        if not self._fs.exists(self._file("commits")):
            return {}
        found = {}
        for status in self._fs.listStatus(self._file("commits")):
            name = status.getPath().getName()
            stream = self._fs.open(status.getPath())
            try:
                said = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            if said.endswith("\n"):
                found[int(name.removesuffix(".json"))] = json.loads(said)
        return found

    def version(self) -> int:
        """The newest version, 0 before any."""
        return max(self._commits(), default=0)

    def _commit(self, version: int, said: dict) -> None:
        try:
            stream = self._fs.create(self._file(f"commits/{version:012d}.json"), False)
        except Exception as e:
            raise Conflict(version) from e
        try:
            stream.write(bytearray((json.dumps(said) + "\n").encode()))
        finally:
            stream.close()

    def write(self, batch: dict[str, DataFrame], replaces: dict[str, int] | None = None) -> int:
        """Store all rows of a batch, by table, as one version, and return it. Rows may have `_deleted`."""
        txn = uuid.uuid4().hex
        for table, rows in batch.items():
            marked = rows if "_deleted" in rows.columns else rows.withColumn("_deleted", F.lit(False))
            marked.write.parquet(f"{self.path}/data/{table}/_txn={txn}")
        said = {"txn": txn, "tables": sorted(batch), "replaces": replaces or {}}
        while True:
            version = self.version() + 1
            try:
                self._commit(version, said)
                return version
            except Conflict:
                if self.version() < version:  # not another writer's commit, but no file at all
                    raise

    def upsert(self, table: str, keys: list[str], rows: DataFrame, deleted: bool = False) -> int:
        return self.write({table: rows.withColumn("_deleted", F.lit(deleted))})

    def delete(self, table: str, keys: list[str], rows: DataFrame) -> int:
        return self.upsert(table, keys, rows.select(*keys), deleted=True)

    def history(self, table: str, version: int | None = None) -> DataFrame:
        """All rows of a table up to a version, with `_version` and `_deleted`."""
        held = {v: c for v, c in self._commits().items() if table in c["tables"] and (version is None or v <= version)}
        if not held:
            raise KeyError(table)
        first = max((c["replaces"].get(table, 0) for c in held.values()), default=0)
        # a compacted batch stands for the versions up to the one that it was made from
        wanted = {c["txn"]: v if table not in c["replaces"] else c["replaces"][table] for v, c in held.items() if v > first or c["replaces"].get(table) == first}
        paths = [f"{self.path}/data/{table}/_txn={t}" for t in wanted]
        rows = self.spark.read.option("basePath", f"{self.path}/data/{table}").option("mergeSchema", "true").parquet(*paths)
        versions = self.spark.createDataFrame(list(wanted.items()), "_txn string, _version long")
        return rows.withColumn("_txn", F.col("_txn").cast("string")).join(F.broadcast(versions), "_txn").drop("_txn")

    def latest(self, table: str, keys: list[str], version: int | None = None) -> DataFrame:
        """The rows of a table, each key's newest, now or as of a version."""
        k = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_version")))
        return self.history(table, version).withColumn("_k", k).where("_k = 1 and not _deleted").drop("_k", "_deleted", "_version")

    def compacted(self, table: str, keys: list[str]) -> int:
        """One batch in place of all before it; what others commit meanwhile stays on top."""
        now = self.version()
        return self.write({table: self.latest(table, keys, now)}, {table: now})

    def decide(self, decisions: DataFrame, findings: DataFrame, table: str = "decisions") -> int:
        """Store a batch of decisions whole, or, if one is on a finding that doesn't exist, none of it."""
        unknown = self.undecidable(decisions, findings).select("finding_id").limit(10).collect()
        if unknown:
            raise ValueError("no such findings: " + ", ".join(str(r[0]) for r in unknown))
        return self.upsert(table, ["finding_id"], decisions)

    @staticmethod
    def listing(analyses: DataFrame, published: DataFrame) -> DataFrame:
        """Analyses, the newest first, with their publication and whether decisions came after it."""
        joined = analyses.join(published.select("analysis_id", "published_at", "version"), "analysis_id", "left")
        return joined.withColumn("stale", F.coalesce(F.col("last_decided_at") > F.col("published_at"), F.lit(False))).orderBy(F.desc("uploaded_at"), "analysis_id")

    @staticmethod
    def undecidable(decisions: DataFrame, findings: DataFrame) -> DataFrame:
        """Decisions on findings that don't exist; a batch with any of these must not be stored."""
        return decisions.join(findings.select("finding_id"), "finding_id", "left_anti")

    @staticmethod
    def surviving(decisions: DataFrame, findings: DataFrame) -> DataFrame:
        """Decisions whose findings a new run finds again."""
        return decisions.join(findings.select("finding_id"), "finding_id", "left_semi")

    @staticmethod
    def client_counts(clients: DataFrame, users: DataFrame, deliverables: DataFrame) -> DataFrame:
        """Clients with their numbers of users and deliverables."""
        count = lambda df, name: df.groupBy("client_id").agg(F.count(F.lit(1)).alias(name))
        joined = clients.join(count(users, "n_users"), "client_id", "left").join(count(deliverables, "n_deliverables"), "client_id", "left")
        return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_users", "n_deliverables")})

    @staticmethod
    def throttle(requests: DataFrame, by: str, at: str, most: int = 3, seconds: int = 3600) -> DataFrame:
        """Whether a request is among the first `most` of its sender within the time before it."""
        w = W.partitionBy(by).orderBy(at).rangeBetween(-seconds, 0)
        return requests.withColumn("allowed", F.count(F.lit(1)).over(w) <= most)

    def cascade(self, analyses: DataFrame, tables: list[str]) -> int:
        """Delete analyses with all that hangs on them, as one version: the rows of `tables` with their analysis_id, by whatever key these have."""
        gone = analyses.select("analysis_id")
        return self.write({table: gone.withColumn("_deleted", F.lit(True)) for table in ["analyses", *tables]})

    @staticmethod
    def published(before: DataFrame, analyses: DataFrame) -> DataFrame:
        """Publications of `analyses` (analysis_id, at): a version more than before, or the first, with a token that only these decide."""
        last = before.select("analysis_id", F.col("version").alias("was"))
        joined = analyses.join(last, "analysis_id", "left").withColumn("version", F.coalesce(F.col("was") + 1, F.lit(1)))
        token = F.substring(F.sha2(F.concat_ws("|", "analysis_id", F.col("version").cast("string"), F.col("at").cast("string")), 256), 1, 32)
        return joined.select("analysis_id", "version", F.col("at").alias("published_at"), token.alias("token"), F.lit(True).alias("is_open"))

    @staticmethod
    def opens(published: DataFrame, log: DataFrame) -> DataFrame:
        """(analysis_id, n_opens, last_opened) of the open publications, from a log of (token, at)."""
        hits = published.where("is_open").join(log, "token", "left")
        return hits.groupBy("analysis_id").agg(F.count("at").alias("n_opens"), F.max("at").alias("last_opened"))

    @staticmethod
    def portal(deliverables: DataFrame, client: str) -> DataFrame:
        """What a client sees: their open deliverables, those in a group first, by group, and the newest first."""
        own = deliverables.where((F.col("client_id") == client) & F.col("is_open"))
        return own.orderBy(F.col("grp").isNull(), "grp", F.desc("published_at"), "deliverable_id")
