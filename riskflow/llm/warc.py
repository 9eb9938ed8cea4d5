"""Deterministic sharded WARC archives.

Records are dealt to ranges of page_id of about equal payload, sorted, and written by one task a range: each
record a gzip member with newly made headers, files rolled by their compressed size. A task writes under
temporary names and renames when its files are whole; the manifest, written last, names the files that
count, with sizes and digests. All bytes follow from the rows, so a task that runs twice writes the same.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskflow.llm.common import MOST_RANGES, cut_points, materialize, range_of

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
FILE_BYTES = 8 << 20
SHARD_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
#: The rows of one payload are dealt to so many parts at least, and to one for so many rows of the table.
LEAST_SALTS, SALT_ROWS = 16, 1_000_000
#: Archives are unpacked in steps of so many bytes.
STEP = 1 << 13
NO_BYTES = hashlib.sha256(b"").hexdigest()
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
MANIFEST = "file string, shard int, records long, bytes long, sha256 string"


def revisits(keys: DataFrame, salts: int = LEAST_SALTS) -> DataFrame:
    """shard, page_id, payload_digest, low of every distinct key that is a revisit of page low.

    keys: shard, page_id, payload_bytes, payload_digest, one row a page. Of equal payloads of at least
    LEAST_REVISIT bytes the row with the smallest page_id is the response; a null page_id is a revisit if any
    row has one, else all such rows are responses. Of rows that repeat that smallest page_id each is a response.
    """
    # A payload may be on a third of all pages: its keys are summed up by salt first, and joined by salt.
    keys = (
        keys.filter(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("shard", "page_id", "payload_digest").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("salt", F.pmod(F.xxhash64("page_id", "shard"), F.lit(salts)).cast("int"))
    )
    first = (
        keys.groupBy("payload_digest", "salt").agg(F.min("page_id").alias("low"), F.sum("n").alias("n"))
        .groupBy("payload_digest").agg(F.min("low").alias("low"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts")).filter("n > 1")
        .withColumn("salt", F.explode("salts")).select("payload_digest", "salt", "low")
    )
    again = F.col("low").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("low")))
    return keys.join(first, ["payload_digest", "salt"]).filter(again).select("shard", "page_id", "payload_digest", "low")


def _id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def _header(value: str, marks: str = "") -> str:
    return re.sub(rf"[\x00-\x1f\x7f{marks}]", lambda m: f"%{ord(m[0]):02X}", value)


def _url(headers: dict[str, str]) -> str | None:
    """The url as it was given: from the header of its own that one with control characters has."""
    if "X-Escaped-URI" not in headers:
        return headers.get("WARC-Target-URI")
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), headers["X-Escaped-URI"])


def record(page_id: int | None, url: str | None, html: bytes, size: int, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has no payload of its own."""
    payload, block_digest = (html, digest) if kind == "response" else (b"", NO_BYTES)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
        if _header(url) != url:
            lines.append(f"X-Escaped-URI: {_header(url, '%')}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{block_digest}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    lines += [f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without time or name."""
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def write(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the archives and the manifest (parquet in path/manifest) below path, and returns the manifest.

    path is a URI that pyarrow's file systems know and all executors share. An empty table gives no files.
    A null html counts as empty. Payloads are shuffled once: what is a revisit is found on ids and digests
    alone, and goes to the shard of its record as a mark that is sorted right before it.
    A file is rolled once its compressed size reaches file_bytes; a record is never split.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2("html", 256))
    # Cuts, weights and marks come from this narrow table: html is read for it and once more for the records.
    spread_key = F.xxhash64("payload_digest", "url")
    narrow = materialize(rows.select("page_id", "payload_bytes", "payload_digest", spread_key.alias("spread_key")), "warc-keys")
    count, total = narrow.agg(F.count(F.lit(1)), F.coalesce(F.sum("payload_bytes"), F.lit(0))).first()
    size = F.col("payload_bytes") + 256
    shard_bytes = max(shard_bytes, -(-total // MOST_RANGES))
    cuts = cut_points(narrow, "page_id", max(1, -(-total // shard_bytes)), size)
    shard = F.coalesce(range_of(F.col("page_id"), cuts), F.lit(len(cuts) + 1)).cast("int")
    # A range is a single id where that id alone is heavy (or null): its rows go to sub-shards by their content.
    weights = narrow.select(shard.alias("shard"), size.alias("w")).groupBy("shard").agg(F.sum("w").alias("w")).collect()  # a row a range
    parts = {r["shard"]: max(1, r["w"] // (2 * shard_bytes)) for r in weights}
    sub, base, spread = F.lit(0), {}, 0
    for k in sorted(parts):
        base[k] = spread
        spread += parts[k]
    for k, n in parts.items():
        if n > 1:
            sub = F.when(F.col("range") == k, F.pmod("spread_key", F.lit(n)).cast("int")).otherwise(sub)
    starts = F.from_json(F.lit(str([base.get(k, 0) for k in range(len(cuts) + 2)])), "array<int>")

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("range", shard).withColumn("shard", F.element_at(starts, F.col("range") + 1) + sub)

    target = path.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(target)
        attempt, done = uuid.uuid4().hex, []
        state: dict = {"shard": None}

        def close() -> None:
            if state.get("file") is None:
                return
            state["file"].close()
            system.move(state["temporary"], f"{root}/{state['name']}")
            done.append((state["name"], state["shard"], state["records"], state["bytes"], state["sha"].hexdigest()))
            state["file"] = None

        for batch in batches:
            for *row, low in zip(*(batch.column(k).to_pylist() for k in range(7))):
                key = (row[0], row[1], row[5])
                if low is not None:
                    state["mark"], state["low"] = key, low
                    continue
                again = state.get("mark") == key
                row += ["revisit", state["low"]] if again else ["response", None]
                if row[0] != state["shard"] or state.get("file") is None:
                    close()
                    state["number"] = state["number"] + 1 if row[0] == state["shard"] else 0
                    state["shard"], state["records"], state["bytes"], state["sha"] = row[0], 0, 0, hashlib.sha256()
                    state["name"] = f"shard-{row[0]:06d}-{state['number']:05d}.warc.gz"
                    state["temporary"] = f"{root}/.{state['name']}.{attempt}"
                    system.create_dir(root, recursive=True)
                    state["file"] = system.open_output_stream(state["temporary"])
                data = member(record(*row[1:]))
                state["file"].write(data)
                state["sha"].update(data)
                state["records"] += 1
                state["bytes"] += len(data)
                if state["bytes"] >= file_bytes:
                    close()
        close()
        columns = list(zip(*done)) or [[]] * 5
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "shard", "records", "bytes", "sha256"])

    marks = revisits(dealt(narrow).select("shard", "page_id", "payload_bytes", "payload_digest"), max(LEAST_SALTS, -(-count // SALT_ROWS)))
    columns = ["shard", "page_id", "url", "html", "payload_bytes", "payload_digest"]
    marked = dealt(rows.withColumn("spread_key", spread_key)).select(*columns, F.lit(None).cast("long").alias("low")).unionByName(marks, allowMissingColumns=True)
    manifest = (
        marked.repartitionById(max(1, spread), "shard")
        .sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "payload_digest", F.col("low").asc_nulls_last(), "url")
        .mapInArrow(run, MANIFEST)
    )
    manifest.write.parquet(f"{target}/manifest")
    drop_temporary(target)
    return pages.sparkSession.read.parquet(f"{target}/manifest")


def drop_temporary(target: str) -> None:
    """Removes what tasks that died or ran twice left under temporary names."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(target)
    for found in system.get_file_info(fs.FileSelector(root)):
        if found.base_name.startswith(".shard-"):
            system.delete_file(found.path)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of one archive, a member at a time; takes time in proportion to its bytes."""
    view, at = memoryview(content), 0
    while at < len(view):
        press, parts = zlib.decompressobj(31), []
        while not press.eof:
            if at >= len(view):
                raise ValueError("the last record is cut off")
            parts.append(press.decompress(view[at:at + STEP]))
            at = min(at + STEP, len(view))
        at -= len(press.unused_data)
        data = b"".join(parts)
        head, _, body = data.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        yield headers, body[:int(headers["Content-Length"])]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record that the manifest vouches for.

    A file whose size or digest is not the manifest's, or a response whose payload is not that of its
    headers, is an error. Files that the manifest doesn't name are passed over.
    """
    target = path.rstrip("/")
    listed = spark.read.parquet(f"{target}/manifest").select("file", "bytes", "sha256")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if listed.limit(1).count() == 0:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.warc.gz").load(target)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(listed, "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                content = batch.column(1)[k].as_py()
                if len(content) != batch.column(2)[k].as_py() or hashlib.sha256(content).hexdigest() != batch.column(3)[k].as_py():
                    raise ValueError(f"{batch.column(0)[k]} is not the file of the manifest")
                rows = []
                for headers, block in parse(content):
                    digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha256:"), headers["WARC-Type"]
                    size = int(headers["X-Payload-Length"])
                    if kind == "response":
                        size, digest = len(block), hashlib.sha256(block).hexdigest()
                        if f"sha256:{digest}" != headers["WARC-Payload-Digest"]:
                            raise ValueError(f"{headers['WARC-Record-ID']} holds another payload")
                    page, refers = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page")
                    rows.append((page and int(page), _url(headers), size, digest, kind, refers and int(refers)))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 6, kinds)], [c.split()[0] for c in schema.split(", ")])

    # A task holds the files of one split: spark.sql.files.maxPartitionBytes, or one file.
    return named.mapInArrow(run, schema)
