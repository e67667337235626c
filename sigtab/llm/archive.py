"""WARC archives of pages: written by Spark's text sink, read back record by record, their index merged from sorted runs."""

from __future__ import annotations

import base64
import time
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtab.llm import common

#: A gzip member of no bytes. The text sink puts it between records, where every reader of gzip passes over it.
NOTHING = bytes.fromhex("1f8b0800000000000003" + "0300" + "00" * 8)
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "run string, place long, offset long, length long, page_id long, url string, captured string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def url_key(url: Column) -> Column:
    """The URL sorted by its site: host labels from the last on, in small letters and without user and port, then ``)``, path and query."""
    pattern = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)([^#]*)[\s\S]*$"
    host = F.regexp_replace(F.lower(F.regexp_extract(url, pattern, 1)), r"^.*@|:[0-9]*$", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(url, pattern, 2))
    return F.when(url.rlike(pattern), key).otherwise(F.coalesce(url, F.lit("")))


def _member(page, url, at, digest, refers_to, size, payload) -> bytes:
    """One record as one gzip member; ``payload`` is None for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{'' if page is None else page}>",
            f"WARC-Date: {time.strftime('%Y-%m-%dT%H:%M:%SZ', time.gmtime(at))}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {url}")
    if payload is None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + pack.flush()


def write(pages: DataFrame, folder: str, html: str = "html", url: str = "url", key: str = "page_id", *, seconds: Column | None = None, least: int = 0, file_bytes: int = 64 << 20) -> None:
    """Write a WARC record for each row of ``pages`` into gzip files below ``folder``, a new folder on any file system Spark writes to.

    The payload is the UTF-8 of ``html`` (null: empty). Of records with equal payloads of at least ``least`` bytes those with the smallest key
    are responses (several only if rows repeat the key), the others revisits that hold no payload. A null key comes after all others.
    ``seconds`` (since 1970, null or outside the years 1970 to 9999: the nearest end) dates the records. A URL with blanks or
    control characters is written percent-encoded as a whole, so that no URL can forge a header.

    Each task writes its rows sorted by URL key, date and key: a run. A file ends before about ``file_bytes`` bytes of payload on average.
    Tasks that are run again replace their files, as with any Spark write.
    """
    clean = F.when(F.col(url).rlike(r"[\x00-\x20\x7F]"), F.url_encode(url)).otherwise(F.col(url))
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    date = F.least(F.lit(253402300799), F.greatest(F.lit(0), F.coalesce(seconds if seconds is not None else F.lit(0), F.lit(0)))).cast("long")
    rows = pages.select(F.col(key).cast("long").alias("page"), clean.alias("url"), date.alias("at"), payload.alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "size": F.octet_length("payload").cast("long"), "key": url_key(F.col("url"))})
    same = rows.where(F.col("size") >= least).groupBy("sha1").agg(F.min("page").alias("first"), F.count("*").alias("n"), F.sum("size").alias("bytes"))
    same = common.stored(same, "payloads")
    known = same.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    each = max(1, int(file_bytes * known[0] / max(1, known[1])))
    shared = same.where("n > 1 and first is not null").select(F.col("sha1").alias("_sha1"), "first")
    met = rows.join(shared, F.col("sha1") == F.col("_sha1"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page"))
    told = met.select("key", "page", "url", "at", "sha1", "size", F.when(revisit, F.col("first")).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"))

    def members(batches):
        names = ("page", "url", "at", "sha1", "refers_to", "size", "payload")
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                out = []
                for page, link, at, sha1, refers, size, body in zip(*(batch.column(c).slice(start, 256).to_pylist() for c in names)):
                    out.append(_member(page, link, at, base64.b32encode(bytes.fromhex(sha1)).decode(), refers, size, body))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    sorted_ = told.sortWithinPartitions("key", "at", "page").select("page", "url", "at", "sha1", "refers_to", "size", "payload")
    lines = sorted_.mapInArrow(members, "member binary").select(F.col("member").cast("string").alias("value"))
    lines.write.option("lineSep", NOTHING.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", each).text(folder)
    common.discard(same)


def records(data: bytes):
    """(offset, length, headers, block) of each record in the bytes of a gzip file of WARC records, one member for each record."""
    at, view = 0, memoryview(data)
    while at < len(view):
        unpack, out, fed = zlib.decompressobj(31), [], at
        while not unpack.eof:
            if fed >= len(view):
                raise ValueError(f"the member at {at} is cut off")
            out.append(unpack.decompress(view[fed : fed + 65536]))
            fed = min(len(view), fed + 65536)
        end = fed - len(unpack.unused_data)
        record = b"".join(out)
        if record:
            head, _, rest = record.partition(b"\r\n\r\n")
            first, *lines = head.decode().split("\r\n")
            named = dict(line.split(": ", 1) for line in lines)
            size = int(named["Content-Length"])
            if not first.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
                raise ValueError(f"no WARC record at {at}")
            yield at, end - at, named, rest[:size]
        at = end


def _page(mark: str | None) -> int | None:
    number = mark[len("<urn:x-page:") : -1] if mark else ""
    return int(number) if number else None


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives in ``folder``: run (the file), place, offset and length (of the member), page_id, url, captured, payload_bytes,
    payload_digest, record_type, refers_to and intact (a response's payload has the length and digest that its record states)."""
    import hashlib

    def parsed(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = []
                for place, (offset, length, named, block) in enumerate(records(memoryview(content.as_buffer()))):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                    kind, digest, good = named["WARC-Type"], named["WARC-Payload-Digest"].partition(":")[2], None
                    if kind == "response":
                        stated, digest = (size, digest), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        size = len(payload)
                        good = stated == (size, digest)
                    rows.append((path, place, offset, length, _page(named["WARC-Record-ID"]), named.get("WARC-Target-URI"), named["WARC-Date"], size, digest, kind, _page(named.get("WARC-Refers-To")), good))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=names)

    names = [x.split()[0] for x in INDEX.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in INDEX.split(", ")]
    files = spark.read.format("binaryFile").load(folder).where("length > 0")
    return files.select("path", "content").mapInArrow(parsed, INDEX)


def loser_tree(keys: list, runs: list[tuple[int, int]]) -> list[int]:
    """The places of ``keys`` in rising order, from sorted runs (start, end). Each inner node keeps the loser of its match, so that a
    new head plays only on its way to the root; equal keys come in order of the runs."""
    k, done = len(runs), (1,)
    at = [start for start, _ in runs]
    head = [(0, keys[start], r) if start < end else done for r, (start, end) in enumerate(runs)]
    loser: list[int | None] = [None] * max(1, k)
    for r in range(k):
        best, node = r, (r + k) // 2
        while node and loser[node] is not None:
            if head[loser[node]] < head[best]:
                best, loser[node] = loser[node], best
            node //= 2
        loser[node] = best
    out = []
    while k and head[loser[0]] is not done:
        best = loser[0]
        out.append(at[best])
        at[best] += 1
        head[best] = (0, keys[at[best]], best) if at[best] < runs[best][1] else done
        node = (best + k) // 2
        while node:
            if head[loser[node]] < head[best]:
                best, loser[node] = loser[node], best
            node //= 2
        loser[0] = best
    return out


def merge(index: DataFrame, per_task: int = 200_000) -> DataFrame:
    """The rows of ``index`` (as of ``read``, with url_key) and their place in history: capture, from 1 for the first capture of its URL key.

    Each run is sorted by URL key, date and page. Ranges of that order are dealt to the tasks (a URL with many captures is cut as well), each
    holds at most about ``per_task`` rows and merges its stretch of every run by a loser tree. How many captures of a URL lie in earlier
    ranges is summed up from one row for each range.
    """
    spark = index.sparkSession
    order = ["url_key", "captured", "page_id", "run", "place"]
    n = index.count()
    parts = max(-(-n // per_task), min(max(1, n // 1000), int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def merged(batches):
        from pyspark import TaskContext

        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        part, urls = TaskContext.get().partitionId(), table.column("url_key").to_pylist()
        pages, files = table.column("page_id").to_pylist(), table.column("run").to_pylist()
        keys = list(zip(urls, table.column("captured").to_pylist(), (p is not None for p in pages), (p or 0 for p in pages)))
        cuts = [0, *(i for i in range(1, len(files)) if files[i] != files[i - 1]), len(files)]
        places, nth, last, count = loser_tree(keys, list(zip(cuts, cuts[1:]))), [], None, 0
        for p in places:
            count = count + 1 if urls[p] == last else 1
            last = urls[p]
            nth.append(count)
        done = table.take(pa.array(places)).combine_chunks()
        for extra, values in (("part", pa.array([part] * len(nth), pa.int32())), ("at", pa.array(range(len(nth)), pa.int64())), ("nth", pa.array(nth, pa.int64()))):
            done = done.append_column(extra, values)
        yield from done.to_batches(max_chunksize=10_000)

    kept = common.stored(index.repartitionByRange(parts, *order).sortWithinPartitions("run", "place").mapInArrow(merged, common.with_columns(index, index.columns, {"part": "int", "at": "long", "nth": "long"})), "history")
    ends = kept.groupBy("part").agg(F.min(F.struct("at", "url_key"))["url_key"].alias("first"), F.max(F.struct("at", "url_key", "nth")).alias("last")).orderBy("part").collect()  # a row for each range
    carry, before, url = [], 0, None
    for r in ends:
        carried = before if r["first"] == url else 0
        carry.append((r["part"], r["first"], carried))
        before = r["last"]["nth"] + (carried if r["last"]["url_key"] == r["first"] else 0)
        url = r["last"]["url_key"]
    table = spark.createDataFrame(carry, "part int, first string, carried long")  # as many rows as ranges
    return kept.join(F.broadcast(table), "part").withColumn("capture", F.col("nth") + F.when(F.col("url_key") == F.col("first"), F.col("carried")).otherwise(0)).drop("part", "at", "nth", "first", "carried")


def archive(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id", *, seconds: Column | None = None, least: int = 0, folder: str | None = None, per_task: int = 200_000) -> DataFrame:
    """Write ``pages`` (``write``), read the archives back (``read``) and merge their index (``merge``): one row for each page, with
    page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, url, captured, capture, run, place, offset, length, intact.

    The archives stay in ``folder`` (else a new one below ``spark.checkpoint.dir``). An empty table gives no row. Repeated rows are records of
    their own. A record whose payload does not come back as written raises ValueError.
    """
    spark = pages.sparkSession
    folder = folder or f"{common.shared_folder(spark)}/llm/warc-{uuid.uuid4().hex}"
    write(pages, folder, html, url, key, seconds=seconds, least=least)
    index = common.stored(read(spark, folder).withColumn("url_key", url_key(F.col("url"))), "captures")
    if index.where("not intact").limit(1).count():
        raise ValueError(f"a payload in {folder} differs from what its record states")
    out = merge(index, per_task)
    return out
