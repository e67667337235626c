"""WARC archives: exact round trips through the files, and the order of their index."""

import base64
import gzip
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtab.llm import archive, common

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                       *[T.StructField(c, T.StringType()) for c in ("key", "page", "sha1", "run", "place", "at", "size")]])
FORGED = "<p>\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\nContent-Length: 0\r\n\r\n"


def odd_pages(seed=4):
    draw = random.Random(seed)
    sites = ["http://a.example.com/", "https://User@B.Example.com:8443/x?q=1#top", "//c.example.org/é/ü", "no address", "", None, "http://d.example.net/a b\r\nWARC-Type: forged"]
    htmls = [None, "", "<p>one</p>", "é日本🙂 \x00\x01\x1f\x8b", FORGED, "line\n\r\nline\r\n", "x" * 300_000, archive.NOTHING.decode("latin-1")]
    rows = [(k, draw.choice(sites), draw.choice(htmls) if k % 3 else f"<html>{k}</html>") for k in draw.sample(range(1000), 400)]
    rows += [(2000 + k, sites[0], htmls[2]) for k in range(150)]  # one address and one payload hold a third of all rows
    rows += [rows[10], rows[10], (None, sites[0], htmls[2]), (None, None, None), (-5, sites[3], "negative")]
    return rows


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, *["z"] * 7) for r in rows], SCHEMA).repartition(parts)


def plain_key(url):
    found = re.match(r"(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)([^#]*)", url or "")
    if not found:
        return url or ""
    host = re.sub(r"^.*@|:[0-9]*$", "", found[1].lower())
    return ",".join(reversed(host.split("."))) + ")" + found[2]


@pytest.mark.parametrize("per_task,least", [(200_000, 0), (40, 0), (40, 12)])
def test_round_trip(spark, tmp_path, per_task, least):
    rows = odd_pages()
    folder = f"file://{tmp_path}/warc"
    done = archive.archive(frame(spark, rows), seconds=F.pmod(F.col("page_id"), F.lit(50)) * 86_400, least=least, folder=folder, per_task=per_task).collect()
    first = {}
    for k, _, html in rows:
        if k is not None and len((html or "").encode()) >= least:
            first[html or ""] = min(k, first.get(html or "", k))
    want = []
    for k, url, html in rows:
        data = (html or "").encode()
        low = first.get(html or "") if len(data) >= least else None
        again = low is not None and low != k
        want.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", low if again else None))
    order = lambda rows: sorted(rows, key=repr)
    assert order((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in done) == order(want)
    assert all(r["intact"] is (True if r["record_type"] == "response" else None) for r in done)

    # each address of the index is one gzip member that holds the record
    payloads = {}
    for r in done:
        with open(r["run"].removeprefix("file:"), "rb") as f:
            f.seek(r["offset"])
            member = gzip.decompress(f.read(r["length"]))
        head, _, rest = member.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode())
        assert head.count(b"WARC-Type:") == 1
        if r["record_type"] == "response":
            payloads.setdefault(r["page_id"], []).append(rest.partition(b"\r\n\r\n")[2][:-4])
    given = {}
    for k, _, html in rows:
        given.setdefault(k, set()).add((html or "").encode())
    assert all(set(p) <= given[k] for k, p in payloads.items())
    for path in {r["run"].removeprefix("file:") for r in done}:
        with open(path, "rb") as f:
            assert gzip.decompress(f.read()).startswith(b"WARC/1.1\r\n")  # any reader of gzip takes the whole file

    # histories: captures of a key by date, then page
    assert {(r["page_id"], r["url_key"]) for r in done} >= {(k, plain_key(u)) for k, u, _ in rows if u is None or not re.search(r"[\x00- \x7f]", u)}
    by_key = {}
    for r in done:
        by_key.setdefault(r["url_key"], []).append(r)
    for all_ in by_key.values():
        all_.sort(key=lambda r: r["capture"])
        assert [r["capture"] for r in all_] == list(range(1, len(all_) + 1))
        ranks = [(r["captured"], r["page_id"] is not None, r["page_id"] or 0) for r in all_]
        assert ranks == sorted(ranks)
    assert max(len(x) for x in by_key.values()) > 150


def test_empty_table_and_dates(spark, tmp_path):
    assert archive.archive(frame(spark, [])).count() == 0
    got = archive.archive(frame(spark, [(1, "http://a/", "x"), (2, "http://a/", "y"), (3, None, "z")], 1), seconds=F.when(F.col("page_id") == 1, F.lit(10**15)).when(F.col("page_id") == 2, F.lit(-7))).collect()
    assert {r["page_id"]: r["captured"] for r in got} == {1: "9999-12-31T23:59:59Z", 2: "1970-01-01T00:00:00Z", 3: "1970-01-01T00:00:00Z"}


def test_files_are_bounded(spark, tmp_path):
    pages = frame(spark, [(k, f"http://a/{k}", f"{k} " * 500) for k in range(300)], 2)
    archive.write(pages, f"{tmp_path}/warc", file_bytes=50_000)
    files = archive.read(spark, f"{tmp_path}/warc").groupBy("run").agg(F.sum("payload_bytes").alias("n")).collect()
    assert len(files) > 5 and max(f["n"] for f in files) < 150_000


def test_broken_archives_are_told(spark):
    member = archive._member(1, "http://a/", 0, "X", None, 4, b"data")
    assert [(x[0], x[1], x[3].endswith(b"data")) for x in archive.records(member + archive.NOTHING)] == [(0, len(member), True)]
    with pytest.raises(ValueError, match="cut off"):
        list(archive.records(member[:-9]))
    with pytest.raises(ValueError, match="no WARC record"):
        list(archive.records(gzip.compress(b"HTTP/1.1\r\nContent-Length: 1\r\n\r\nx")))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    draw = random.Random(k)
    keys, runs = [], []
    for _ in range(k):
        run = sorted((draw.randint(0, 9), draw.choice("ab")) for _ in range(draw.choice([0, 1, 5, 30])))
        runs.append((len(keys), len(keys) + len(run)))
        keys += run
    assert archive.loser_tree(keys, runs) == sorted(range(len(keys)), key=lambda i: keys[i])  # stable: by run among equals


def test_common_merge_of_many_runs(spark):
    rows = [(f"run{r}", p, f"key{p * 7 % 5 if r % 2 else p // 9}", "d", r * 100 + p) for r in range(6) for p in range(40)]
    for_run = {}
    for r in rows:
        for_run.setdefault(r[0], []).append(r)
    ready = [(run, p, u, d, i) for run, xs in for_run.items() for p, (_, _, u, d, i) in enumerate(sorted(xs, key=lambda x: (x[2], x[3], x[4])))]
    index = common.stored(spark.createDataFrame(ready, "run string, place long, url_key string, captured string, page_id long"), "test")
    got = archive.merge(index, per_task=25).collect()
    want, seen = {}, {}
    for run, p, u, d, i in sorted(ready, key=lambda x: (x[2], x[3], x[4])):
        seen[u] = seen.get(u, 0) + 1
        want[run, p] = seen[u]
    assert {(r["run"], r["place"]): r["capture"] for r in got} == want
