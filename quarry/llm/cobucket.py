"""A pair of tables, rewritten so that rows of one key lie in the files of one bucket: metadata first.

``start`` lays both tables out in numbered files, as they might come.  ``cobucket`` then reads no more than keys
and file names, and counts rows by (start file, bucket): the contingency matrix, at most ``BUCKETS`` + 2 squared
cells a table.  A file with one bucket whose bucket has no other file is that bucket's file already and stays;
every other bucket is written anew from the files that its column of the matrix lists, and those only are read.

A row of the child table without a parent has a bucket of its own, so that the join of both tables can go bucket
by bucket; whether there is a parent comes from a join with the parents' keys, counted, whose hot keys adaptive
execution splits.  Rows are sorted by ranges of (file or bucket, all columns, place), so that a hot key or bucket
is many tasks; each range leaves its sorted runs, and one task a file strings the runs together as a stream,
which is all that one task sees of a large bucket.

Files get names of their own attempt, and only those that a task has returned count: attempts that are
repeated after a lost executor leave files that are removed in the end, like the starting files that do not
stay.  The driver sees names of files and the matrix's cells, both bounded by the number of buckets.

Defined cases: a null key of the parents goes to the bucket of null keys, and joins with nothing; repeated rows
and keys are kept, and joined rows are counted with both multiplicities; columns of any names come along and take
part in the order, also such as ``bucket`` or ``file``; texts of any length; a table without rows has no files, and
its children no parents; -0.0 and 0.0 are equal in the order.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from quarry import storage
from quarry.llm.common import located, new_folder, table, written
from quarry.storage import file_system

KEY, CHILD_KEY = "sale_id", "item_id"
BUCKETS = 300
#: Buckets of child rows without a parent, and of null keys.
ORPHANS, NULLS = BUCKETS, BUCKETS + 1
SALT = "line"
#: Rows, and bytes, that a stream gathers for a row group.
ROWS, BYTES = 1 << 19, 64 << 20


def hashed(key: Column, salt: str = "") -> Column:
    """The unsigned CRC32 of a decimal key, modulo the number of buckets; null for null."""
    return F.pmod(F.crc32(F.concat(F.lit(salt), key.cast("string"))), F.lit(BUCKETS)).cast("int")


def bucket_of(key: Column, has_parent: Column) -> Column:
    return F.when(key.isNull(), NULLS).when(has_parent, hashed(key, SALT)).otherwise(ORPHANS)


def parent_start(rows: Column) -> Column:
    """The starting file of a parent: its bucket, or the one before where the bucket is 1 modulo 3."""
    bucket = bucket_of(rows[KEY], F.lit(True))
    return bucket - F.when(bucket % 3 == 1, 1).otherwise(0)


def child_start(rows: Column) -> Column:
    return F.coalesce(hashed(rows[CHILD_KEY]), F.lit(0))


def _flat(rows: DataFrame, numbers: Column, columns: list[str]) -> tuple[DataFrame, str]:
    """Columns of located rows, a column of file numbers with a name that is free, and that name; sorted runs."""
    number = next(n for n in (f"n{i}" for i in range(len(columns) + 1)) if n not in {c.lower() for c in columns})
    rest = [c for c in columns if c != KEY]
    order = [F.col(f"doc.`{c}`") for c in (KEY, *rest)]
    numbered = rows.select("doc", F.xxhash64("file", "row").alias("t"), numbers.alias("number"))
    dealt = numbered.repartitionByRange("number", *order, "t").sortWithinPartitions("number", *order)
    return dealt.select(F.col("number").alias(number), *[F.col(f"doc.`{c}`").alias(c) for c in columns]), number


def _strung(source_paths: list[str], target: str) -> None:
    """One Parquet file of the rows of others, in their order, as a stream."""
    store, at = file_system(target)
    writer, held, size, rows = None, [], 0, 0
    with store.open_output_stream(at) as sink:
        for path in source_paths:
            src, src_at = file_system(path)
            with src.open_input_file(src_at) as f:
                for batch in pq.ParquetFile(f).iter_batches(batch_size=1 << 15):
                    if writer is None:
                        writer = pq.ParquetWriter(sink, batch.schema)
                    held.append(batch)
                    size, rows = size + batch.nbytes, rows + batch.num_rows
                    if rows >= ROWS or size >= BYTES:
                        writer.write_table(pa.Table.from_batches(held))
                        held, size, rows = [], 0, 0
        if held:
            writer.write_table(pa.Table.from_batches(held))
        writer.close()


def write_files(rows: DataFrame, numbers: Column, columns: list[str], folder: str, name: str) -> DataFrame:
    """(number, path): a sorted file for each number that has rows, of located ``rows``."""
    spark = rows.sparkSession
    flat, number = _flat(rows, numbers, columns)
    runs = new_folder(spark, f"{name}-runs")
    flat.write.partitionBy(number).parquet(runs)
    schema = StructType([*[f for f in flat.schema if f.name != number]]).add(number, IntegerType())
    path = F.col("_metadata.file_path")
    found = spark.read.schema(schema).parquet(runs).groupBy(F.col(number).alias("number"), path.alias("path")).agg(F.count(F.lit(1)).alias("n"))
    run = F.struct(F.regexp_extract("path", r"/part-(\d+)-", 1).cast("long").alias("at"), "path")
    work = found.groupBy("number").agg(F.sort_array(F.collect_list(run)).alias("runs")).select("number", "runs.path")
    store, inside = file_system(folder)
    store.create_dir(inside)

    def string_together(batches):
        for batch in batches:
            for number, paths in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = f"{folder}/{name}-{number:05d}-{uuid.uuid4().hex}.parquet"
                _strung(paths, target)
                yield pa.RecordBatch.from_pylist([{"number": number, "path": target}], _MADE)

    tasks = min(BUCKETS + 2, spark.sparkContext.defaultParallelism * 4)
    made = work.repartition(tasks).mapInArrow(string_together, "number int, path string")
    return written(made, f"{name}-files")


_MADE = pa.schema([("number", pa.int32()), ("path", pa.string())])


def _clean(folder: str, keep: set[str]) -> None:
    """Removes the files of a folder that are not to stay: starting files, and those of repeated attempts."""
    from pyarrow import fs

    store, at = file_system(folder)
    names = {p.rsplit("/", 1)[1] for p in keep}
    for info in store.get_file_info(fs.FileSelector(at)):
        if info.is_file and info.base_name not in names:
            store.delete_file(info.path)


def start(parents: DataFrame, children: DataFrame, folder: str) -> None:
    """Both tables in numbered, sorted files: ``folder``/sales and ``folder``/sale_lines."""
    for name, rows, number in (("sales", parents, parent_start), ("sale_lines", children, child_start)):
        made = write_files(located(rows), number(F.col("doc")), rows.columns, f"{folder}/{name}", "start")
        _clean(f"{folder}/{name}", {r.path for r in made.collect()})


def _files(spark: SparkSession, folder: str, schema: StructType, paths: list[str] | None = None) -> DataFrame:
    """(doc, file, row, s: the number of the file) of starting files."""
    rows = spark.read.schema(schema).parquet(*(paths or [folder]))
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^start-(\d+)-", 1).cast("int")
    return rows.select(
        F.struct(*[F.col(f"`{c}`") for c in schema.names]).alias("doc"),
        F.xxhash64(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.row_index").alias("row"),
        number.alias("s"),
    )


def _with_parents(children: DataFrame, parents: DataFrame) -> DataFrame:
    """``children`` (doc, file, row, s) with ``m``, the number of parents of the row, null for none; all rows stay.

    Null keys, which may be many, are spread over keys of their own that no parent has.
    """
    key = F.col("doc").getField(KEY)
    keyed = children.withColumn("none", key.isNull()).withColumn("k", F.coalesce(key, F.xxhash64("file", "row")))
    counted = parents.withColumn("none", F.lit(False))
    return keyed.join(counted, ["k", "none"], "left").drop("k", "none")


def cobucket(spark: SparkSession, folder: str, parent_schema: StructType, child_schema: StructType) -> DataFrame:
    """(table_name, bucket, path, n_joined, rewritten, lineage): the final files, a row each; the others are removed."""
    schemas = {"sales": parent_schema, "sale_lines": child_schema}
    files = {n: written_paths(spark, f"{folder}/{n}") for n in schemas}
    key = F.col("doc").getField(KEY)
    empty = spark.createDataFrame([], "s int, bucket int, n long, joined long")
    parents = spark.createDataFrame([], "k long, m long")
    if files["sales"]:
        parents = _files(spark, f"{folder}/sales", parent_schema).where(key.isNotNull()).groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("m"))
        parents = written(parents, "parents")

    def buckets(name: str, paths: list[str] | None = None) -> DataFrame:
        rows = _files(spark, f"{folder}/{name}", schemas[name], paths)
        if name == "sales":
            return rows.withColumn("bucket", bucket_of(key, F.lit(True))).withColumn("m", F.lit(None).cast("long"))
        return _with_parents(rows, parents).withColumn("bucket", bucket_of(key, F.col("m").isNotNull()))

    cells, out = [], []
    for name in schemas:
        made = empty
        if files[name]:
            made = buckets(name).groupBy("s", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("joined"))
        cells.append(written(made.withColumn("table_name", F.lit(name)), "matrix"))
    matrix = cells[0].unionByName(cells[1])
    joined = cells[1].groupBy("bucket").agg(F.coalesce(F.sum("joined"), F.lit(0).cast("long")).alias("n_joined"))
    cell = F.struct("s", "n")
    columns = matrix.groupBy("table_name", "bucket").agg(F.sort_array(F.collect_list(cell)).alias("sources"))  # a cell a file
    rows = matrix.groupBy("table_name", "s").agg(F.count(F.lit(1)).alias("buckets"))
    only = columns.where(F.size("sources") == 1).withColumn("s", F.col("sources")[0]["s"])
    stays = only.join(rows.where("buckets = 1"), ["table_name", "s"]).select("table_name", "bucket", "s")
    stay = {n: {r.bucket: r.s for r in stays.where(F.col("table_name") == n).collect()} for n in schemas}  # at most the buckets
    for name, schema in schemas.items():
        at = f"{folder}/{name}"
        kept = [(name, b, files[name][s], False) for b, s in stay[name].items()]
        changed = [p for s, p in sorted(files[name].items()) if s not in set(stay[name].values())]
        new = []
        if changed:
            todo = buckets(name, changed)
            made = write_files(todo, F.col("bucket"), schema.names, at, "bucket")
            new = [(name, r.number, r.path, True) for r in made.collect()]
        out += kept + new
    for name in schemas:
        _clean(f"{folder}/{name}", {x[2] for x in out})
    final = spark.createDataFrame(out, "table_name string, bucket int, path string, rewritten boolean")
    return final.join(columns, ["table_name", "bucket"]).join(joined, "bucket", "left")


def written_paths(spark: SparkSession, folder: str) -> dict[int, str]:
    """Starting files by number."""
    from pyarrow import fs

    store, at = file_system(folder)
    found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return {int(i.base_name.split("-")[1]): f"{folder}/{i.base_name}" for i in found if i.base_name.startswith("start-")}


def _read_back(batches):
    """(path, columns, n_rows, ids_sha256) of files, each as a stream of its keys."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, at = file_system(path)
            digest, n = hashlib.sha256(), 0
            with store.open_input_file(at) as f:
                file = pq.ParquetFile(f)
                for part in file.iter_batches(batch_size=1 << 16, columns=[KEY]):
                    ids = pc.fill_null(part.column(0).cast(pa.string()), "")
                    digest.update(("," * (n > 0) + ",".join(ids.to_pylist())).encode())
                    n += len(ids)
                names = ",".join(file.schema_arrow.names)
            yield pa.RecordBatch.from_pylist([{"path": path, "columns": names, "n_rows": n, "ids_sha256": digest.hexdigest()}], _BACK)


_BACK = pa.schema([("path", pa.string()), ("columns", pa.string()), ("n_rows", pa.int64()), ("ids_sha256", pa.string())])


def described(files: DataFrame) -> DataFrame:
    """The final files with what they hold, read back from them."""
    spark = files.sparkSession
    tasks = min(2 * BUCKETS + 4, spark.sparkContext.defaultParallelism * 4)
    back = files.select("path").repartition(tasks).mapInArrow(_read_back, "path string, columns string, n_rows long, ids_sha256 string")
    lineage = F.array_join(F.transform("sources", lambda c: F.concat_ws(":", c["s"], c["n"])), ",")
    joined = F.when(F.col("bucket") < BUCKETS, F.col("n_joined"))
    return files.join(back, "path").select(
        "table_name",
        "path",
        "columns",
        "ids_sha256",
        F.sha2(lineage, 256).alias("lineage_sha256"),
        F.col("bucket").cast("long").alias("bucket"),
        "n_rows",
        F.coalesce(joined, F.lit(0).cast("long")).alias("n_joined"),
        "rewritten",
    )


def query(parents: DataFrame, children: DataFrame) -> DataFrame:
    spark = parents.sparkSession
    folder, mark = new_folder(spark, "cobucket", keep=True), storage.mark()
    start(parents, children, folder)
    storage.drop(mark)
    files = cobucket(spark, folder, parents.schema, children.schema)
    out = written(described(files), "cobucket-result")
    storage.drop(mark, keep=storage.last())
    return out


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(table(spark, sf_dir, "sales"), table(spark, sf_dir, "sale_lines"))
