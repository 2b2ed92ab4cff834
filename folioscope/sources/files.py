"""A corpus as files: JSON records whatever the compression, Markdown with front matter, and a tree of files written from rows.

- ``corpus_records`` tells gzip by its first bytes, not by a name, and takes one record, a list of records, an object of lists
  (each list is a kind of record), or a record on each line.
- ``markdown_tree`` reads a subset of YAML between two lines of three dashes: scalars (quoted or not, numbers, booleans, nulls), lists
  in brackets or by dashes, maps by indentation, and text blocks after | or >. What it doesn't know is an error of that
  file, in the column ``fault``; the others are read.
- ``export_tree`` writes one file for each row under a temporary name and renames it, leaves files alone whose digest the last
  manifest has, and deletes those that no row names any more; paths that are absolute, climb up or come twice are refused
  before anything is written.

A file is read or written whole by one task: the size of a file is what bounds its memory.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.arrow import small_batches
from folioscope.sources.tables import kept

_FILES = "path string, modificationTime timestamp, length long, content binary"


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    found = spark.read.schema(_FILES).format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return small_batches(found).select("path", "content")


# --------------------------------------------------------------------------- JSON


def records_of(content: bytes) -> list[tuple[str, str]]:
    """(kind, record as JSON) of a file's content."""
    text = (gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content).decode("utf-8-sig").strip()
    if not text:
        return []
    try:
        whole = json.loads(text)
    except json.JSONDecodeError:
        whole = [json.loads(line) for line in text.splitlines() if line.strip()]
    out = lambda kind, rows: [(kind, json.dumps(r, ensure_ascii=False)) for r in rows]
    if isinstance(whole, dict) and any(isinstance(v, list) and v and all(isinstance(x, dict) for x in v) for v in whole.values()):
        return [x for kind, rows in whole.items() if isinstance(rows, list) for x in out(kind, (r for r in rows if isinstance(r, dict)))]
    return out("", whole if isinstance(whole, list) else [whole])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
            fault, rows = None, []
            try:
                rows = records_of(content)
            except (ValueError, OSError, EOFError) as e:
                fault = f"{type(e).__name__}: {e}"
            rows = [(kind, k, r, None) for k, (kind, r) in enumerate(rows)] if fault is None else [(None, 0, None, fault)]
            columns = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *columns], ["path", "kind", "ord", "record", "fault"])


def corpus_records(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, kind, ord, record, fault): every record of the files at path as JSON; a file that can't be read is one row with
    its fault."""
    return _files(spark, path, pattern).mapInArrow(_records, "path string, kind string, ord long, record string, fault string")


def typed(records: DataFrame, kind: str, schema: str) -> DataFrame:
    """The records of a kind as columns."""
    return records.filter((F.col("kind") == kind) & F.col("fault").isNull()).select(F.from_json("record", schema).alias("r")).select("r.*")


# --------------------------------------------------------------------------- Markdown with front matter

_NUMBER = re.compile(r"[-+]?(?:\d+|\d+\.\d*(?:[eE][-+]?\d+)?|\.\d+)")


def _scalar(text: str):
    text = text.strip()
    if text[:1] == '"' and text[-1:] == '"' and len(text) > 1:
        return json.loads(text)
    if text[:1] == "'" and text[-1:] == "'" and len(text) > 1:
        return text[1:-1].replace("''", "'")
    if text[:1] == "[" and text[-1:] == "]":
        parts = re.findall(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,'"][^,]*)\s*(?:,|$)""", text[1:-1])
        return [_scalar(p) for p in parts]
    text = re.sub(r"\s+#.*$", "", text)
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if _NUMBER.fullmatch(text):
        return int(text) if text.lstrip("+-").isdigit() else float(text)
    if text[0] in "&*!|>@`{%":
        raise ValueError(f"this part of YAML is not known: {text[:20]!r}")
    return text


def _block(lines: list[tuple[int, str]], at: int, depth: int) -> tuple[object, int]:
    """The list or map whose lines have this indentation."""
    out: list | dict | None = None
    while at < len(lines) and lines[at][0] >= depth:
        indent, line = lines[at]
        if indent > depth:
            raise ValueError(f"unexpected indentation: {line!r}")
        if line.startswith("- ") or line == "-":
            out = [] if out is None else out
            if not isinstance(out, list):
                raise ValueError(f"a list among keys: {line!r}")
            out.append(_scalar(line[1:]))
            at += 1
            continue
        if isinstance(out, list):  # a list may stand as far out as its key: the next key ends it
            break
        m = re.match(r"""("[^"]*"|'[^']*'|[^\s:#][^:]*?)\s*:(?:\s+(.*)|\s*)$""", line)
        if not m:
            raise ValueError(f"neither key nor list item: {line!r}")
        out = {} if out is None else out
        key, value, at = str(_scalar(m[1])), (m[2] or "").strip(), at + 1
        if value[:1] in ("|", ">") and len(value) <= 2:
            part = []
            while at < len(lines) and (lines[at][0] > depth or not lines[at][1]):
                part.append(lines[at])
                at += 1
            least = min((i for i, x in part if x), default=0)
            said = [" " * (i - least) + x if x else "" for i, x in part]
            joined = "\n".join(said).rstrip("\n") if value[0] == "|" else re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(said)).rstrip()
            out[key] = joined + ("" if value[1:] == "-" else "\n")
        elif not value and at < len(lines) and (lines[at][0] > depth or lines[at][0] == depth and lines[at][1].startswith("-")):
            out[key], at = _block(lines, at, lines[at][0])
        else:
            out[key] = _scalar(value)
    return out, at


def front_matter(text: str) -> tuple[dict, str]:
    """The front matter and the body of a Markdown file; no front matter is an empty one."""
    m = re.match(r"\ufeff?---[ \t]*\r?\n(.*?)^---[ \t]*(?:\r?\n|\Z)", text, re.S | re.M)
    if not m:
        return {}, text
    lines = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in m[1].splitlines()]
    # blank lines count within text blocks only, comments nowhere
    useful = [(i, x) for k, (i, x) in enumerate(lines) if x and not x.startswith("#") or not x and k and _in_block(lines, k)]
    found, read = _block(useful, 0, 0) if useful else ({}, 0)
    if not isinstance(found, dict) or read < len(useful):
        raise ValueError("front matter without keys")
    return found, text[m.end() :]


def _in_block(lines: list[tuple[int, str]], k: int) -> bool:
    """Whether a blank line stands within a text block: the last key of less indentation before it opens one."""
    depth = next((i for i, x in lines[k + 1 :] if x), 0)
    return depth > 0 and any(re.search(r":\s+[|>]-?$", x) and i < depth for i, x in reversed(lines[:k]))


def _markdown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for content in batch["content"].to_pylist():
            try:
                front, body = front_matter(content.decode("utf-8"))
                rows.append((json.dumps(front, ensure_ascii=False), body, None))
            except ValueError as e:
                rows.append((None, None, f"{type(e).__name__}: {e}"))
        yield pa.RecordBatch.from_arrays([batch["path"], *(pa.array([r[j] for r in rows], pa.string()) for j in range(3))], ["path", "front", "body", "fault"])


def markdown_tree(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """(path, front, body, fault) of the Markdown files below path; front: JSON."""
    return _files(spark, path, pattern).mapInArrow(_markdown, "path string, front string, body string, fault string")


# --------------------------------------------------------------------------- a tree of files


def _yaml(value) -> str:
    if isinstance(value, list):
        return "[" + ", ".join(map(_yaml, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def with_front(front: dict, body: str) -> str:
    """A Markdown file of which front_matter gives the same back."""
    return "---\n" + "".join(f"{json.dumps(k, ensure_ascii=False)}: {_yaml(v)}\n" for k, v in front.items()) + "---\n" + body


def _write(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    fs, folder = pa.fs.FileSystem.from_uri(root)
    for batch in batches:
        for name, content, known, gone in zip(*(batch[c].to_pylist() for c in ("file", "content", "known", "gone")), strict=True):
            at = f"{folder}/{name}"
            if gone:
                if fs.get_file_info(at).type == pa.fs.FileType.File:
                    fs.delete_file(at)
            elif not known:
                fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                draft = f"{at}.{uuid.uuid4().hex}.tmp"
                with fs.open_output_stream(draft) as f:
                    f.write(content)
                fs.move(draft, at)
        digests = [None if c is None else hashlib.sha256(c).hexdigest() for c in batch["content"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["file"], pa.array(digests, pa.string()), batch["known"], batch["gone"]], ["file", "digest", "known", "gone"])


def export_tree(rows: DataFrame, root: str, file: str, content: str, manifest: DataFrame | None = None) -> DataFrame:
    """Write content (a text) of each row to the file named by the column ``file``, below root; returns the manifest (file,
    digest). manifest: that of the last export to root."""
    rows = small_batches(rows).select(F.col(file).alias("file"), F.col(content).cast("binary").alias("content"))
    unsafe = rows.filter(F.col("file").isNull() | F.col("content").isNull() | F.col("file").rlike(r"^/|^$|(^|/)\.\.?(/|$)|//|/$|[\x00-\x1F\\]")).limit(1).count()
    twice = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    if unsafe or twice:
        raise ValueError("refused: " + ("a path that is no plain one below the root, or no content" if unsafe else "two rows for one file"))
    old = rows.sparkSession.createDataFrame([], "file string, digest string") if manifest is None else manifest.select("file", "digest")
    old = old.withColumnsRenamed({"digest": "was"})
    both = rows.join(old, "file", "full")
    both = both.select("file", "content", F.coalesce(F.sha2("content", 256) == F.col("was"), F.lit(False)).alias("known"), F.col("content").isNull().alias("gone"))
    done = kept(both.mapInArrow(lambda it: _write(it, root), "file string, digest string, known boolean, gone boolean"), "exported")
    return done.filter("not gone").select("file", "digest")
