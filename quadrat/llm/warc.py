"""WARC derivatives: from each response a linked ``metadata`` and a plain-text ``conversion`` record.

Both records refer to the response (WARC-Refers-To), keep its target URI and date, and carry digests of their own blocks;
the metadata record keeps the source's HTTP headers and its payload digest, and lists title, language and outgoing links.
Identifiers are derived from the response's, so a rerun gives the same records. The plan is one narrow Arrow-batched
step, and ``write`` makes valid WARC files out of the records with Spark's own text sink, a file a partition. ``read``
gives the responses of WARC files (plain or gzipped) with their own headers, dates and digests; a task holds one file.

Defined results: a null payload is empty; a null URI leaves out the URI header and the links stay relative; blanks and
control characters are percent-encoded in a URI header and a blank in all others, so no value can end a line; rows that
repeat give repeated records; broken markup never raises (an unclosed comment, script, style or textarea runs to the end;
an unclosed svg, template, noscript or title and a self-closed svg lose their own tag only; a lone "<" is text); an empty table gives no records; other columns are passed over.
"""

from __future__ import annotations

import base64
import hashlib
import html
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm import common as C

DATE = "1970-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD = "record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, header string, block string"

#: Every pattern runs in linear time: none goes past the next "<" but those that may end only at their own end or the text's.
DROPPED = re.compile(r"""<!--|<(script|style|noscript|template|title|textarea|svg)(?![\w-])(?:(?:[^<>"']|"[^"<]*"|'[^'<]*')*+|[^<>]*)>""", re.I)
CHUNK = re.compile(rb"([0-9A-Fa-f]+)[^\r\n]*\r\n")
ENDS = {k: re.compile(rf"</{k}\s*>" if k else "-->", re.I) for k in ("", "script", "style", "noscript", "template", "title", "textarea", "svg")}
TO_THE_END = ("", "script", "style", "textarea")
BLOCKS = re.compile(r"""</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|tr|ul)\b(?:[^<>"']|"[^"<]*"|'[^'<]*')*+>""", re.I)
TAGS = re.compile(r"""</?[a-zA-Z!?](?:[^<>"']|"[^"<]*"|'[^'<]*')*+>""")
TITLE = re.compile(r"<title\b[^<>]*>([^<]*)", re.I)
LANG = re.compile(r"""<html\b[^<>]*?\blang\s*=\s*["']?([A-Za-z0-9-]+)""", re.I)
HREF = re.compile(r"""<a\b[^<>]*?\bhref\s*=\s*(?:"([^"<>]*)"|'([^'<>]*)'|([^\s"'<>]+))""", re.I)
SPACE = re.compile(r"[^\S\n]+")
CONTROL, BARE = re.compile(r"[\x00-\x1f\x7f]"), re.compile(r"[\x00-\x20\x7f\x85\u2028\u2029]")


def without_dropped(page: str) -> str:
    """A page with a blank for each comment and element that isn't shown. Each kind of end is looked for until it is first missed, so time stays linear."""
    out, at, missed = [], 0, set()
    while m := DROPPED.search(page, at):
        kind = (m[1] or "").lower()
        alone = kind in missed or (kind == "svg" and m[0].endswith("/>"))
        end = None if alone else ENDS[kind].search(page, m.end())
        out += [page[at : m.start()], " "]
        if end:
            at = end.end()
        elif kind in TO_THE_END:
            at = len(page)
        else:
            at = m.end()
            missed |= set() if alone else {kind}
    return "".join([*out, page[at:]])


def plain_text(page: str) -> str:
    """The visible text of a page, a line for each block, without blank lines."""
    text = html.unescape(TAGS.sub("", BLOCKS.sub("\n", without_dropped(page))))
    return "\n".join(x for x in (x.strip() for x in SPACE.sub(" ", text).split("\n")) if x)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(record_id: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, record_id + '#' + kind)}>"


def one(x: str) -> str:
    """x in one line."""
    return " ".join(CONTROL.sub(" ", x).split())


def fields(page: str, uri: str | None, http: str, payload: bytes, source_digest: str | None = None) -> str:
    """The metadata record's application/warc-fields. source_digest: the payload's as the source gives it."""
    out = [("source-status", one(http.split("\r\n", 1)[0]))]
    out += [("source-header", one(x)) for x in http.split("\r\n")[1:] if x.strip()]
    out += [("source-payload-digest", one(source_digest) if source_digest else digest(payload)), ("source-payload-length", str(len(payload)))]
    if m := TITLE.search(page):
        out.append(("title", one(html.unescape(m[1]))))
    if m := LANG.search(page):
        out.append(("language", m[1]))
    for m in HREF.finditer(page):
        link = one(html.unescape(m[1] or m[2] or m[3] or ""))
        try:
            link = urljoin(uri or "", link)
        except ValueError:
            pass
        out.append(("outlink", one(link)))
    return "".join(f"{k}: {v}\r\n" for k, v in out)


def record(kind: str, source_id: str, uri: str | None, date: str, content_type: str, block: str) -> tuple:
    data = block.encode("utf-8", "replace")
    own, code = derived_id(source_id, kind), digest(data)
    head = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", one(source_id)), ("WARC-Date", one(date)), ("WARC-Block-Digest", code), ("Content-Type", content_type), ("Content-Length", str(len(data)))]
    head[3:3] = [("WARC-Target-URI", BARE.sub(lambda m: "".join(f"%{c:02X}" for c in m[0].encode()), uri))] if uri is not None else []
    return kind, own, source_id, uri, date, content_type, len(data), code, "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head), block


def derivatives(responses: DataFrame, key: str = "page_id") -> DataFrame:
    """Of (key, record_id, target_uri, warc_date, http, payload and, if there is one, payload_digest) rows, two records for each: key and RECORD's columns."""
    kind = responses.schema[key].dataType.simpleString()
    responses = responses if "payload_digest" in responses.columns else responses.withColumn("payload_digest", F.lit(None).cast("string"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        for b in batches:
            out = []
            for k, rid, uri, date, http, page, code in zip(b["_key"].astype(object), b.record_id, b.target_uri, b.warc_date, b.http, b.payload, b.payload_digest):
                page, uri, k = page or "", uri if isinstance(uri, str) else None, None if pd.isna(k) else k
                rid, date = rid if isinstance(rid, str) else "", date if isinstance(date, str) else DATE
                out.append((k, *record("metadata", rid, uri, date, "application/warc-fields", fields(page, uri, http or "", page.encode("utf-8", "replace"), code))))
                out.append((k, *record("conversion", rid, uri, date, "text/plain; charset=utf-8", plain_text(page))))
            yield pd.DataFrame(out, columns=["_key", *names])

    own = responses.select(F.col(key).alias("_key"), "record_id", "target_uri", "warc_date", "http", "payload", "payload_digest")
    out = own.mapInPandas(build, f"_key {kind}, {RECORD}")
    return out.select(F.col("_key").alias(key), *[c for c in out.columns if c not in ("_key", key)])


def responses(pages: DataFrame, date: str = DATE, http: str = HTTP) -> DataFrame:
    """Stored pages as WARC responses; their identifiers are digests of id, URL and payload."""
    h = F.md5(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    rid = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))
    return pages.select("page_id", rid.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"), F.lit(http).alias("http"), F.coalesce("html", F.lit("")).alias("payload"))


def _members(data: bytes) -> bytes:
    """The content of a file, unpacked if it is gzipped (any number of members; what follows a broken one is lost)."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        try:
            out += [z.decompress(data), z.flush()]
        except zlib.error:
            break
        data = z.unused_data
    return b"".join(out)


def _headers(head: bytes) -> dict[str, str]:
    pairs = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _body(http: dict[str, str], body: bytes) -> str:
    """An HTTP body as text: chunks joined, unpacked, and decoded by its charset (UTF-8 where it names none)."""
    if http.get("transfer-encoding", "").lower() == "chunked":
        parts, at = [], 0
        while m := CHUNK.match(body, at):
            size = int(m[1], 16)
            parts.append(body[m.end() : m.end() + size])
            at = m.end() + size + 2
            if not size:
                break
        body = b"".join(parts) if parts else body
    try:
        body = {"gzip": lambda b: zlib.decompress(b, 31), "deflate": zlib.decompress}.get(http.get("content-encoding", "").lower(), bytes)(body)
    except zlib.error:
        pass
    charset = re.search(r"charset=[\"']?([\w-]+)", http.get("content-type", ""), re.I)
    try:
        return body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def parsed(data: bytes) -> Iterator[tuple]:
    """(record_id, target_uri, warc_date, http, payload, payload_digest) of each response in a WARC file; it ends at the first record that is none."""
    data, at = _members(data), 0
    while data.startswith(b"WARC/", at) and (end := data.find(b"\r\n\r\n", at)) >= 0:
        head = _headers(data[at:end])
        size = int(head.get("content-length") or 0)
        block = data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4
        if head.get("warc-type") == "response":
            http, _, body = block.partition(b"\r\n\r\n")
            code = head.get("warc-payload-digest") or digest(body)
            yield head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-date"), http.decode("utf-8", "replace") + "\r\n\r\n", _body(_headers(http), body), code


def read(spark: SparkSession, path: str) -> DataFrame:
    """record_id, target_uri, warc_date, http, payload, payload_digest: the responses of WARC files."""
    names = ["record_id", "target_uri", "warc_date", "http", "payload", "payload_digest"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                found = parsed(data)
                while some := list(itertools.islice(found, 256)):
                    yield pd.DataFrame(some, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"{n} string" for n in names))


def write(records: DataFrame, path: str) -> None:
    """The records as WARC files: header, blank line, block, two line ends, as the format asks."""
    records.select(F.concat("header", F.lit("\r\n"), "block").alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def op9_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    return derivatives(responses(C.table(spark, sf_dir, "pages")))
