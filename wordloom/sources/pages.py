"""Wiki pages: Markdown files with a YAML block, read into rows and written back."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wordloom.functions.text import content_hash, is_safe_path
from wordloom.operators.delivery import instant

#: File names that are no pages.
RESERVED = ("index.md", "log.md")
#: Keys of the block that are columns; all others go to ``extra`` as JSON.
KNOWN = (
    "type", "id", "title", "description", "resource", "tags", "links", "sources", "generated", "timestamp", "created_at",
    "updated_at", "revision",
)

_PARSED = (
    "id string, title string, tags array<string>, links array<string>, sources array<struct<id: string, resource: string>>, "
    "created string, updated string, generated_at string, timestamp string, revision int, entry_type string, "
    "description string, generated_by string, extra map<string, string>, body string, parse_error string"
)


def _loader():
    """A YAML loader in which dates, ``yes`` and ``no`` are text."""
    import yaml

    class Core(yaml.SafeLoader):
        pass

    Core.yaml_implicit_resolvers = {
        first: [(tag, pattern) for tag, pattern in rules if tag.rpartition(":")[2] in ("null", "int", "float", "bool")]
        for first, rules in yaml.SafeLoader.yaml_implicit_resolvers.items()
        if first not in "yYnNoO"
    }
    return lambda text: yaml.load(text, Core)  # noqa: S506


def _source(value: object) -> dict:
    if isinstance(value, bool):
        return {"id": None, "resource": str(value).lower()}
    if isinstance(value, (str, int, float)):
        return {"id": None, "resource": str(value)}
    if isinstance(value, dict) and isinstance(value.get("resource"), str) and isinstance(value.get("id"), (str, type(None))):
        return {"id": value.get("id"), "resource": value["resource"]}
    raise ValueError("a source is text or a mapping with a resource")


def parse_page(text: str, load) -> dict:
    """The parts of one page; raises ValueError where it isn't one."""
    text = text.replace("\r\n", "\n").lstrip()
    if not text.startswith("---"):
        raise ValueError("no opening fence")
    block, fence, body = text[3:].partition("\n---")
    if not fence:
        raise ValueError("no closing fence")
    keys = load(block) or {}
    if not isinstance(keys, dict):
        raise ValueError("the block is no mapping")

    def string(name: str) -> str | None:
        value = keys.get(name)
        if value is not None and not isinstance(value, (str, int, float)):
            raise ValueError(f"{name} is no text")
        return None if value is None else str(value)

    def strings(name: str) -> list[str]:
        value = keys.get(name) or []
        if not isinstance(value, list) or not all(isinstance(v, (str, int, float)) for v in value):
            raise ValueError(f"{name} is no list of texts")
        return [str(v) for v in value]

    made = keys.get("generated")
    made = made if isinstance(made, dict) and isinstance(made.get("by"), str) else {}
    sources = keys.get("sources") or []
    if not isinstance(sources, list):
        raise ValueError("sources is no list")
    return {
        "id": string("id"), "title": string("title"), "tags": strings("tags"), "links": strings("links"),
        "sources": [_source(s) for s in sources], "created": string("created_at"), "updated": string("updated_at"),
        "generated_at": made.get("at") if isinstance(made.get("at"), str) else None, "timestamp": string("timestamp"),
        "revision": int(keys.get("revision") or 1), "entry_type": string("type"), "description": string("description"),
        "generated_by": made.get("by"), "extra": {str(k): json.dumps(v, default=str) for k, v in keys.items() if k not in KNOWN},
        "body": body.lstrip("\n"), "parse_error": None,
    }


def parse_pages(files: DataFrame) -> DataFrame:
    """Pages of ``files(path, text)``; ``path`` is relative and names a page without an id.

    A page that doesn't parse keeps its path and hashes and says why in ``parse_error``. ``updated_at`` is the explicit
    one, else that of ``generated``, else ``timestamp``; without any of them, and for ``created_at``, null.
    """
    names = [c.split()[0] for c in _PARSED.split(", ") if " " in c and not c.startswith("resource")]

    @F.pandas_udf(_PARSED)
    def parsed(texts: pd.Series) -> pd.DataFrame:
        load, rows = _loader(), []
        for text in texts:
            try:
                rows.append(parse_page(text or "", load))
            except Exception as error:  # one bad page must not end the scan
                rows.append(dict.fromkeys(names) | {"parse_error": f"{type(error).__name__}: {error}"[:500]})
        return pd.DataFrame(rows, columns=names)

    p = files.select("path", F.sha2("text", 256).alias("source_hash"), parsed("text").alias("p")).select("path", "source_hash", "p.*")
    page = p.withColumn("id", F.coalesce("id", F.regexp_replace("path", r"\.md$", "")))
    times = {c: instant(F.col(c)) for c in ("created", "updated", "generated_at", "timestamp")}
    explicit = F.when(F.col("updated").isNotNull(), times["updated"]).otherwise(
        F.coalesce(times["generated_at"], F.when(F.col("timestamp").isNotNull(), times["timestamp"]))
    )
    strict = F.array_compact(
        F.array(
            *[F.when(F.col(c).isNotNull() & times[c].isNull(), f"{c} is no RFC 3339 time") for c in ("created", "updated")],
            F.when(F.col("updated").isNull() & times["generated_at"].isNull() & F.col("timestamp").isNotNull() & times["timestamp"].isNull(), "timestamp is no RFC 3339 time"),
            F.when(~is_safe_path("id"), "the id is no safe path"),
        )
    )
    error = F.coalesce("parse_error", F.get(strict, 0))
    return page.select(
        "path", "id", F.coalesce("title", "id").alias("title"), F.col("body").alias("content"), "tags", "links", "sources",
        times["created"].alias("created_at"), explicit.alias("updated_at"), "revision", "entry_type", "description",
        "generated_by", "extra", "source_hash", content_hash("body").alias("content_hash"), error.alias("parse_error"),
    )


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages below a folder. Reserved names are no pages; Spark does not list names that begin with ``_`` or ``.``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    base = folder.rstrip("/").removeprefix("file://")
    relative = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + _quoted(base) + "/+", "")
    read = files.select(relative.alias("path"), F.decode("content", "UTF-8").alias("text"))
    return parse_pages(read.where(~F.substring_index("path", "/", -1).isin(*RESERVED)))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in text)


def render_pages(pages: DataFrame, actor: str = "wordloom") -> DataFrame:
    """``path, text`` of each page as Markdown; parse_pages() reads the same page from it."""

    @F.pandas_udf("string")
    def rendered(heads: pd.Series, bodies: pd.Series) -> pd.Series:
        import yaml

        out = []
        for head, body in zip(heads, bodies):
            keys = json.loads(head)
            keys |= {k: json.loads(v) for k, v in (keys.pop("extra", None) or {}).items()}
            out.append("---\n" + yaml.safe_dump(keys, sort_keys=False, allow_unicode=True) + "---\n\n" + (body or ""))
        return pd.Series(out)

    at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    head = F.struct(
        F.col("entry_type").alias("type"), "id", "title", "description", "tags", "links", "sources",
        F.struct(F.coalesce("generated_by", F.lit(actor)).alias("by"), at("updated_at").alias("at")).alias("generated"),
        at("created_at").alias("created_at"), at("updated_at").alias("updated_at"), "revision", "extra",
    )
    return pages.select(F.concat("id", F.lit(".md")).alias("path"), rendered(F.to_json(head), "content").alias("text"))


def write_pages(files: DataFrame, folder: str) -> DataFrame:
    """Write ``files(path, text)`` below a folder that every executor has mounted, each by a rename; ``path, bytes`` of each.

    The work is done where the result is read. A path that would leave the folder is an error.
    """
    base = folder.removeprefix("file://").rstrip("/")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = []
            for path, text in zip(batch["path"], batch["text"]):
                target = os.path.normpath(os.path.join(base, path))
                if not target.startswith(base + "/"):
                    raise ValueError(f"{path} leaves the folder")
                os.makedirs(os.path.dirname(target), exist_ok=True)
                fresh = f"{target}.{os.getpid()}.tmp"
                raw = (text or "").encode()
                with open(fresh, "wb") as file:
                    file.write(raw)
                os.replace(fresh, target)
                sizes.append(len(raw))
            yield pd.DataFrame({"path": batch["path"], "bytes": sizes})

    return files.select("path", "text").mapInPandas(run, "path string, bytes bigint")


def media_type(path: Column | str) -> Column:
    """Kind of a raw document by its name."""
    p = F.lower(F.col(path) if isinstance(path, str) else path)
    return F.when(p.endswith(".md"), "markdown").when(p.endswith(".json"), "json").otherwise("text")


def canonical_json_hash(text: str | None) -> str | None:
    """SHA-256 of a JSON value written compactly with sorted keys; None for what is no JSON."""
    try:
        value = json.loads(text)
    except (TypeError, ValueError):
        return None
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


@F.pandas_udf(StringType())
def payload_hash(texts: pd.Series) -> pd.Series:
    """canonical_json_hash() of a column."""
    return texts.map(canonical_json_hash)
