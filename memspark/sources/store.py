"""The store: Parquet tables with a folder for each bank. Writes touch the folders of their banks only.

Inserting adds files; updating and deleting rewrite or remove the folders of the banks concerned, by Spark's dynamic partition overwrite, which
replaces them at the job's commit. Ids follow from contents, and rows that are there already aren't inserted again, so an
operation that failed half-way is made whole by running it again. Writers of one bank must take turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark import schemas

TABLES = {
    "facts": schemas.FACTS, "entities": schemas.ENTITIES, "graph_links": schemas.LINKS + ", bank_id bigint", "sources": schemas.SOURCES, "fact_sources": schemas.FACT_SOURCES + ", bank_id bigint",
    "terms": "term string, fact_id bigint, positions array<int>, bank_id bigint", "banks": schemas.BANKS,
}
#: What tells the rows of a bank's table apart.
KEYS = {"facts": ["fact_id"], "entities": ["name"], "graph_links": ["source_id", "target_id", "link_type"], "sources": ["source_id"], "fact_sources": ["fact_id", "source_id"], "terms": ["fact_id", "term"], "banks": []}
#: What an update may change in a fact; its network and type stay.
MUTABLE = ("content", "entity_ids", "temporal_start", "temporal_end", "embedding", "confidence", "evidence_ids", "updated_at", "consolidated_at")


def get_facts(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """Facts by id, of any bank."""
    return facts.join(ids.select("fact_id"), "fact_id", "left_semi")


def upsert_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entities by (bank, name): a new one replaces aliases and type and takes over the id that is there."""
    key = ["bank_id", "name"]
    latest = new.groupBy(*key).agg(F.max_by(F.struct("entity_id", "entity_type", "aliases"), "entity_id").alias("n"))
    both = old.join(latest, key, "full")
    return both.select(*key, F.coalesce("entity_id", "n.entity_id").alias("entity_id"), F.coalesce("n.entity_type", "entity_type").alias("entity_type"), F.coalesce("n.aliases", "aliases").alias("aliases")).select(*old.columns)


def update_facts(facts: DataFrame, changes: DataFrame) -> DataFrame:
    """Facts with the mutable columns that changes has, by id; null changes too."""
    columns = [c for c in MUTABLE if c in changes.columns]
    new = changes.select("fact_id", F.struct(*columns).alias("__new"))
    joined = facts.join(new, "fact_id", "left")
    return joined.select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in facts.columns])


def mark_consolidated(facts: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    marked = ids.select("fact_id").distinct().withColumn("__marked", F.lit(True))
    when = F.when(F.col("__marked"), F.lit(at).cast("timestamp_ntz")).otherwise(F.col("consolidated_at"))
    return facts.join(marked, "fact_id", "left").withColumn("consolidated_at", when).select(*facts.columns)


def link_facts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new that old doesn't have, each once."""
    return new.dropDuplicates(["fact_id", "source_id"]).join(old, ["fact_id", "source_id"], "left_anti")


def without_orphans(links: DataFrame, facts: DataFrame) -> DataFrame:
    """Links both of whose ends are facts."""
    ids = facts.select("fact_id")
    for end in ("source_id", "target_id"):
        links = links.join(ids.withColumnRenamed("fact_id", end), end, "left_semi")
    return links


class MemoryStore:
    """The tables of a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, name: str):  # noqa: ANN202
        """(file system, path) of a table's folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def read(self, name: str) -> DataFrame:
        """A table; empty if nothing was ever written to it, and an error if it can't be read."""
        files, folder = self._folder(name)
        columns = self.spark.createDataFrame([], TABLES[name]).columns
        if not files.exists(folder) or not files.listStatus(folder):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}").select(*columns)

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        shape = self.spark.createDataFrame([], TABLES[name]).schema
        have = set(rows.columns)
        # large banks are split over tasks, small ones share a task
        return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape]).hint("rebalance", "bank_id")

    def insert(self, name: str, rows: DataFrame) -> None:
        """Adds the rows that aren't there yet; no file that is there changes."""
        key = ["bank_id", *KEYS[name]]
        new = rows.dropDuplicates(key).join(self.read(name).select(*key), key, "left_anti")
        self._shaped(name, new).write.mode("append").partitionBy("bank_id").parquet(f"{self.path}/{name}")

    def replace(self, name: str, banks: DataFrame, rows: DataFrame) -> None:
        """rows in place of all rows that the banks (bank_id) have; other banks' files stay. rows may be made of the table itself."""
        kept = rows.select("bank_id").distinct()
        empty = [r.bank_id for r in banks.select("bank_id").distinct().join(kept, "bank_id", "left_anti").collect()]  # banks that lose all their rows
        self._shaped(name, rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bank_id").parquet(f"{self.path}/{name}")
        self._drop(name, empty)

    def _drop(self, name: str, banks: list[int]) -> None:
        files, folder = self._folder(name)
        for bank in banks:
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(folder, f"bank_id={bank}"), True)

    def of_banks(self, name: str, banks: DataFrame) -> DataFrame:
        """The rows of some banks."""
        return self.read(name).join(banks.select("bank_id").distinct(), "bank_id", "left_semi")

    def update_facts(self, changes: DataFrame) -> None:
        """Changes facts by id (see update_facts); changes has bank_id too, and only its banks are rewritten."""
        self.replace("facts", changes, update_facts(self.of_banks("facts", changes), changes.drop("bank_id")))

    def mark_consolidated(self, ids: DataFrame, at: str) -> None:
        """Marks facts (bank_id, fact_id)."""
        self.replace("facts", ids, mark_consolidated(self.of_banks("facts", ids), ids, at))

    def upsert_entities(self, rows: DataFrame) -> None:
        old = self.of_banks("entities", rows)
        self.replace("entities", rows, upsert_entities(old, rows.select(*old.columns)))

    def insert_links(self, rows: DataFrame) -> None:
        """Adds links (bank_id, source_id, target_id, link_type, weight, seq); the weight of the last written one holds."""
        from memspark.operators.links import upsert

        old = self.of_banks("graph_links", rows)
        bank = rows.select("bank_id", "source_id").unionAll(old.select("bank_id", "source_id")).distinct()
        self.replace("graph_links", rows, upsert(old.drop("bank_id"), rows.drop("bank_id")).join(bank, "source_id"))

    def index_facts(self, terms: DataFrame, facts: DataFrame) -> None:
        """Puts the terms (a positional index) of facts (bank_id, fact_id) in place of those that they had."""
        old = self.of_banks("terms", facts).join(facts.select("bank_id", "fact_id"), ["bank_id", "fact_id"], "left_anti")
        self.replace("terms", facts, old.unionByName(terms))

    def create_bank(self, rows: DataFrame) -> None:
        """Adds banks; raises if a disposition or a bias is out of its range."""
        bad = rows.where("skepticism not between 1 and 5 or literalism not between 1 and 5 or empathy not between 1 and 5 or bias_strength not between 0 and 1")
        if not bad.isEmpty():
            raise ValueError("dispositions are from 1 to 5, and a bias from 0 to 1")
        self.insert("banks", rows)

    def get_bank(self, bank_id: int) -> DataFrame:
        found = self.read("banks").where(F.col("bank_id") == bank_id)
        if found.isEmpty():
            raise KeyError(f"no bank {bank_id}")
        return found

    def list_banks(self) -> DataFrame:
        return self.read("banks").orderBy("name")

    def list_entities(self, bank_id: int) -> DataFrame:
        return self.read("entities").where(F.col("bank_id") == bank_id).orderBy("name")

    def delete_bank(self, bank_id: int) -> None:
        """Removes a bank's folders, the bank's own last; no other file is read or written."""
        for name in sorted(TABLES, key=lambda n: n == "banks"):
            self._drop(name, [bank_id])

    def reset_consolidation(self) -> None:
        """Removes observations, their terms and links to them, and marks all facts as not yet consolidated."""
        facts = self.read("facts")
        gone = facts.where("network = 'observation'").select("bank_id", "fact_id")
        links, terms = self.read("graph_links"), self.read("terms")
        lost = links.join(gone.select(F.col("fact_id").alias("source_id")), "source_id", "left_semi").unionByName(links.join(gone.select(F.col("fact_id").alias("target_id")), "target_id", "left_semi"))
        touched = lost.select("bank_id").distinct()
        self.replace("graph_links", touched, without_orphans(self.of_banks("graph_links", touched), facts.where("network <> 'observation'")))
        self.replace("terms", gone, self.of_banks("terms", gone).join(gone, ["bank_id", "fact_id"], "left_anti"))
        stale = facts.where("network = 'observation' or consolidated_at is not null").select("bank_id").distinct()
        kept = self.of_banks("facts", stale).where("network <> 'observation'").withColumn("consolidated_at", F.lit(None).cast("timestamp_ntz"))
        self.replace("facts", stale, kept)
