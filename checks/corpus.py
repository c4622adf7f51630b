"""The driver tables in the shapes the operators work on.

Each adapter has a twin of the same name in :mod:`checks.oracles`, written in
SQL. Texts, paths and faults vary with the row number, so that the rules under
test are all met.
"""

from __future__ import annotations

import io
import math
import warnings
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ziplore.operators.validate import dedupe_members
from ziplore.session import configure, pin, scratch_path
from ziplore.sources.archives import list_archives
from ziplore.sources.storage import qualified, resolve
from ziplore.sources.tables import files_from_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(value) -> Column:
    return value.cast("string")


def numbered(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """documents with ``n`` (place in its project) and ``flavour``."""
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return docs.withColumns(
        {
            "project_id": F.col("source"),
            "n": F.floor(F.col("doc_id") / 20).cast("long"),
            "flavour": (F.col("doc_id") % 4).cast("int"),
        }
    )


def raw_files(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """``project_id, seq, rel_path, content`` with repeated paths."""
    d = numbered(spark, sf_dir, docs)
    n, ns, last = F.col("n"), text_of(F.col("n")), F.col("n") % 10

    def named(before, after, *middle):
        return F.concat(F.lit(before), *middle, ns, F.lit(after))

    lang = F.concat(F.col("lang"), F.lit("/"))
    path = (
        F.when(n == 0, "README.md")
        .when((n == 5) & (F.col("flavour") == 0), "pyproject.toml")
        .when((n == 5) & (F.col("flavour") == 1), "package.json")
        .when((n == 5) & (F.col("flavour") == 2), "Dockerfile")
        .when(n == 5, "sub/go.mod")
        .when(last == 0, named("docs/guide_", ".md"))
        .when(last == 1, named("src/mod_", ".py"))
        .when(last == 2, F.concat(F.lit("src/"), lang, named("util_", ".JS")))
        .when(n % 20 == 13, named("config/ci_", ".yml"))
        .when(last == 3, named("config/conf_", ".json"))
        .when(last == 4, F.concat(F.lit("data/"), lang, named("notes_", ".txt")))
        .when(last == 5, named("build/script_", ".sh"))
        .when(last == 6, named("assets/logo_", ".png"))
        .when(last == 7, F.concat(F.lit("src/pkg_"), text_of(n % 3), F.lit("/main.py")))
        .when(last == 8, named("misc/blob_", ".bin"))
        .otherwise(named("cfg/.env_", ""))
    )
    json_body = F.concat(
        F.lit('{"doc_id": '), text_of(F.col("doc_id")), F.lit(', "lang": "'), F.col("lang"),
        F.lit('", "n": '), ns, F.lit(', "text": "'), escaped(F.col("text")), F.lit('"}'),
    )
    py_body = F.concat(
        F.lit('import os\nTEXT = "'), escaped(F.col("text")), F.lit('"\nclass Doc_'), ns, F.lit(":\n    pass\ndef load_"), ns, F.lit("():\n    pass\n")
    )
    yaml_body = F.concat(
        F.lit("doc_id: "), text_of(F.col("doc_id")), F.lit("\nlang: "), F.col("lang"), F.lit("\nn: "), ns,
        F.lit('\ntext: "'), escaped(F.col("text")), F.lit('"\n'),
    )
    content = (
        F.when(last == 8, F.concat(F.repeat(F.lit("\x01"), F.lit(400)), F.col("text")))
        .when(F.col("rel_path").endswith(".yml"), yaml_body)
        .when(F.col("rel_path").endswith(".json"), json_body)
        .when(F.col("rel_path").endswith(".py"), py_body)
        .otherwise(F.col("text"))
    )
    return d.withColumn("rel_path", path).select(
        "project_id", n.alias("seq"), "rel_path", content.alias("content")
    )


def files(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """The ``files`` model with repeated paths."""
    return files_from_table(
        raw_files(spark, sf_dir, docs), "project_id", "seq", "rel_path", "content"
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive members, some outside their root: ``project_id, seq, member_name, size_bytes``."""
    d = numbered(spark, sf_dir)
    n, ns, k = F.col("n"), text_of(F.col("n")), F.col("doc_id") % 20
    name = (
        F.when((k == 3) & (n % 13 == 4), F.concat(F.lit("a/../../evil_"), ns))
        .when((k == 7) & (n % 11 == 2), F.lit("/etc/x"))
        .when(n % 4 == 0, F.concat(F.lit("./pkg//mod_"), text_of(n % 7), F.lit(".py")))
        .when(n % 4 == 1, F.concat(F.lit("a/../b/"), text_of(n % 5), F.lit(".txt")))
        .when(n % 4 == 2, F.concat(F.lit("docs/"), F.col("lang"), F.lit("/"), ns, F.lit(".md")))
        .otherwise(F.concat(F.lit("x\\y_"), ns))
    )
    return d.select(
        "project_id",
        n.alias("seq"),
        name.alias("member_name"),
        F.octet_length("text").cast("long").alias("size_bytes"),
    )


def odd_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, id, path``: page addresses and awkward names."""
    docs = table(spark, sf_dir, "documents")
    pages = table(spark, sf_dir, "pages")
    id_, k = text_of(F.col("doc_id")), F.col("doc_id") % 14
    path = F.when(F.lit(False), F.lit(""))
    shapes = [
        F.lit(".env"), F.concat(F.lit("foo"), id_, F.lit(".")), F.lit("..foo"),
        F.concat(F.lit("a"), id_, F.lit(".tar.gz")), F.lit("dir/Dockerfile"), F.lit("a..b"),
        F.lit(".a.b"), F.lit("..."), F.concat(F.lit("x//y/./z_"), id_, F.lit(".TXT")),
        F.concat(F.lit("docs/Read.Me."), F.col("lang")), F.concat(F.lit("win\\path_"), id_, F.lit(".py")),
        F.concat(F.lit("src/"), F.col("lang"), F.lit("/App.JS")), F.lit("./lib/tool.ts"),
        F.lit("a.b/c/"),
    ]
    for i, shape in enumerate(shapes):
        path = path.when(k == i, shape)
    return (
        docs.select(F.lit("documents").alias("src"), F.col("doc_id").alias("id"), path.alias("path"))
        .unionByName(
            pages.select(F.lit("pages").alias("src"), F.col("page_id").alias("id"), F.col("url").alias("path"))
        )
    )


def escaped(text: Column) -> Column:
    """A text as the inside of a quoted JSON or Python string."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for char, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def odd_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, id, text``: documents with headings and blanks, pages, conversations."""
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 9
    text = F.col("text")
    varied = (
        F.when(k == 0, F.concat(F.lit("# "), text))
        .when(k == 1, F.concat(F.lit("  \n## "), F.lit("\u2003Title of "), F.col("source"), F.lit("  \n"), text))
        .when(k == 2, F.concat(F.lit("####### "), text))
        .when(k == 3, F.concat(F.lit("\u3000\u2009"), text, F.lit("\xa0\x1c\n")))
        .when(k == 4, F.replace(text, F.lit("."), F.lit(",")))
        .when(k == 5, F.replace(text, F.lit(" "), F.lit("_")))
        .otherwise(text)
    )
    pages, talks = table(spark, sf_dir, "pages"), table(spark, sf_dir, "conversations")
    return (
        docs.select(F.lit("documents").alias("src"), F.col("doc_id").alias("id"), varied.alias("text"))
        .unionByName(
            pages.select(F.lit("pages").alias("src"), F.col("page_id").alias("id"), F.col("html").alias("text"))
        )
        .unionByName(
            talks.select(
                F.lit("conversations").alias("src"),
                (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
                "text",
            )
        )
    )


def odd_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, content``: around 30 % control bytes, empty and missing content."""
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 10
    some = F.repeat(F.lit("\x01"), (F.lit(295) + F.col("doc_id") % 25).cast("int"))
    content = (
        F.when(k == 0, F.lit(""))
        .when(k == 1, F.lit(None).cast("string"))
        .when(k == 2, F.concat(F.repeat(F.lit("\t\n"), F.lit(300)), F.col("text")))
        .when(k == 3, F.concat(F.repeat(F.lit("a"), F.lit(1024)), F.repeat(F.lit("\x02"), F.lit(900))))
        .otherwise(F.concat(some, F.col("text")))
    )
    return docs.select("doc_id", content.cast("binary").alias("content"))


def encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, content``: valid UTF-8, long ASCII, and bytes that are not UTF-8."""
    docs = table(spark, sf_dir, "documents")
    raw = F.col("text").cast("binary")
    ascii_only = F.octet_length("text") == F.length("text")
    content = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(b"\xff\r\n"), raw, F.lit(b"\r")))
        .when(F.col("doc_id") % 5 == 1, F.repeat(F.col("text"), (F.lit(70_000) / F.greatest("n_chars", F.lit(1))).cast("int") + 1).cast("binary"))
        .when(ascii_only, F.repeat(F.col("text"), F.lit(3)).cast("binary"))
        .otherwise(raw)
    )
    return docs.select("doc_id", content.alias("content"))


def yaml_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text``: mappings, lists, plain scalars and things that do not parse, each with a whole document."""
    docs = table(spark, sf_dir, "documents")
    id_, k = text_of(F.col("doc_id")), F.col("doc_id") % 6
    quoted = F.concat(F.lit('"'), escaped(F.col("text")), F.lit('"'))
    text = (
        F.when(k == 0, F.concat(F.lit("doc_id: "), id_, F.lit("\nlang: "), F.col("lang"), F.lit("\nn: 3\ntext: "), quoted, F.lit("\n")))
        .when(k == 1, F.concat(F.lit("- a\n- "), F.col("source"), F.lit("\n- c\n- "), quoted, F.lit("\n- e\n- f\n")))
        .when(k == 2, quoted)
        .when(k == 3, F.concat(F.lit("# "), quoted, F.lit("\n")))
        .when(k == 4, F.concat(F.lit("1: x\n2: "), quoted, F.lit("\n")))
        .otherwise(F.concat(F.lit("a: 1\n---\nb: "), quoted, F.lit("\n")))
    )
    return docs.select("doc_id", text.alias("text"))


def python_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text``: 0-4 classes, 0-3 functions, async ones, broken ones."""
    docs = table(spark, sf_dir, "documents")
    id_, c, f = text_of(F.col("doc_id")), F.col("doc_id") % 5, F.floor(F.col("doc_id") / 5) % 4
    # The whole document comes first, so that names stand far into long sources.
    body = F.concat(F.lit('"'), escaped(F.col("text")), F.lit('"\n'))
    for i in range(1, 5):
        piece = F.concat(F.lit(f"class C{i}_"), id_, F.lit(":\n    def method(self):\n        pass\n"))
        body = F.concat(body, F.when(c >= i, piece).otherwise(F.lit("")))
    for i in range(1, 4):
        piece = F.concat(F.lit(f"def f{i}_"), id_, F.lit("():\n    return 1\nasync def g():\n    pass\n"))
        body = F.concat(body, F.when(f >= i, piece).otherwise(F.lit("")))
    text = F.when(F.col("doc_id") % 9 == 8, F.concat(body, F.lit("def (:\n"))).otherwise(body)
    return docs.select("doc_id", text.alias("text"))


def stored_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, summaries_json``: good lists, broken JSON and lists with a bad item."""
    docs = table(spark, sf_dir, "documents")
    id_, k = text_of(F.col("doc_id")), F.col("doc_id") % 5
    first = F.concat(
        F.lit('{"rel_path": " src\\\\m_'), id_, F.lit('.py ", "kind": "python", "summary": "Python", "lines": '),
        text_of(F.col("n_chars")), F.lit("}"),
    )
    body = (
        F.when(k == 0, F.concat(F.lit("["), first, F.lit(', {"rel_path": "a.txt"}]')))
        .when(k == 1, F.concat(F.lit("["), first, F.lit(', {"rel_path": "b.txt", "kind": "nonsense"}]')))
        .when(k == 2, F.concat(F.lit("["), first))
        .when(k == 3, F.lit("[]"))
        .otherwise(
            F.concat(F.lit('[{"rel_path": "c.json", "kind": "json", "summary": "'), F.col("lang"),
                     F.lit('", "size_bytes": 7, "language": null}]'))
        )
    )
    return docs.select("doc_id", body.alias("summaries_json"))


def result_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id`` and the six result fields, each rule broken somewhere."""
    docs = table(spark, sf_dir, "documents")
    id_, k = text_of(F.col("doc_id")), F.col("doc_id") % 11
    return docs.select(
        "doc_id",
        F.when(k == 0, F.lit(" \u3000 ")).otherwise(F.concat(F.lit(" src\\f_"), id_, F.lit(".py "))).alias("rel_path"),
        F.when(k == 1, "binary").when(k == 2, "text").otherwise("python").alias("kind"),
        F.concat(F.lit(" "), F.col("text"), F.lit("\n")).alias("summary"),
        F.when(k == 3, F.lit(-1)).otherwise(F.col("n_chars")).cast("long").alias("lines"),
        F.when(k == 4, F.lit(-5)).otherwise(F.col("n_chars") * 2).cast("long").alias("size_bytes"),
        F.when(k == 5, F.lit(None).cast("string")).otherwise(F.col("lang")).alias("language"),
    )


def summary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id`` and project summary fields, each rule broken somewhere."""
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 11
    return docs.select(
        "doc_id",
        F.when(k == 0, "").otherwise(F.col("source")).alias("project_name"),
        F.col("text").alias("description"),
        F.col("text").alias("architecture_notes"),
        F.when(k == 1, F.lit(-1)).otherwise(F.lit(3)).cast("long").alias("file_count"),
        F.when(k == 2, F.lit(-1)).otherwise(F.col("n_chars")).cast("long").alias("line_count"),
    )


def job_messages(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """``job_id, event_id, ts, msg``; closes are rare enough for jobs to get on."""
    events = table(spark, sf_dir, "events") if events is None else events
    kind, id_ = F.col("event_type"), F.col("event_id")
    msg = (
        F.when((kind == "purchase") & (id_ % 7 == 0), F.lit("close"))
        .when((kind == "purchase") & (id_ % 7 == 1), F.lit("event:ANALYSIS_COMPLETED"))
        .when((kind == "error") & (id_ % 5 == 0), F.concat(F.lit("error:"), F.col("props")))
        .when(kind == "signup", F.lit("event:NewUpload"))
        .when((kind == "view") & (id_ % 3 == 0), F.lit("event:TreeBuilt"))
        .when((kind == "view") & (id_ % 3 == 1), F.lit("event:AnalysisComplete"))
        .when(kind == "view", F.lit("event:FileDiscovered"))
        .when(kind == "click", F.lit("event:FileAnalysed"))
        .otherwise(F.concat(F.lit("note:"), kind))
    )
    return events.select(
        F.col("user_id").alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), msg.alias("msg")
    )


CUTS = 3
#: Equal parts that a span of numbers is cut into at a time when a rank is looked for.
PARTS = 4096


def ranked_values(rows: DataFrame, column: str, ranks: list[int], low: int, high: int) -> dict[int, int]:
    """The whole numbers at some ranks (from 0) of a column that lies between ``low`` and ``high``; pass pinned rows.

    Rows are counted in equal parts of the span that holds a rank, and in parts of
    that part, until a part is one number. So a task holds no more than the counts
    of ``PARTS`` parts for each rank, however many numbers differ.
    """
    held = {r: (low, high, 0) for r in ranks}
    while open_ := sorted({(a, b) for a, b, _ in held.values() if a < b}):
        value, counts = F.col(column), {}
        tagged = []
        for k, (a, b) in enumerate(open_):
            width = -(-(b - a + 1) // PARTS)
            part = F.expr(f"(`{column}` - {a}L) DIV {width}L")
            tagged.append(F.when(value.between(a, b), F.struct(F.lit(k).alias("span"), part.alias("part"))))
        # Spans may be shared by ranks but don't overlap.
        found = rows.select(F.coalesce(*tagged).alias("p")).filter("p IS NOT NULL").groupBy("p.span", "p.part").count()
        for span, part, n in found.collect():
            counts.setdefault(open_[span], {})[part] = n
        for r, (a, b, before) in held.items():
            if a == b:
                continue
            width = -(-(b - a + 1) // PARTS)
            for part, n in sorted(counts[a, b].items()):
                if before + n > r:
                    held[r] = (a + part * width, min(b, a + (part + 1) * width - 1), before)
                    break
                before += n
    return {r: a for r, (a, _, _) in held.items()}


def percentiles(rows: DataFrame, column: str, shares: list[float]) -> list[float]:
    """What ``percentile`` gives for a column of whole numbers, which holds all that differ in one task; zeros if there are none."""
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n:
        return [0.0] * len(shares)
    places = [(n - 1) * s for s in shares]
    at = ranked_values(rows, column, sorted({f(p) for p in places for f in (math.floor, math.ceil)}), low, high)
    below, above = [at[math.floor(p)] for p in places], [at[math.ceil(p)] for p in places]
    return [float(a) if a == b else (math.ceil(p) - p) * a + (p - math.floor(p)) * b for p, a, b in zip(places, below, above)]


def messages_in_cuts(spark: SparkSession, sf_dir: str) -> str:
    """The job messages in folders ``cut=0``, ``cut=1`` ... of about equal rows, one file each, written in order of time."""
    folder = scratch_path(spark, "messages")
    messages = pin(job_messages(spark, sf_dir))
    at = F.unix_micros("ts")
    borders = percentiles(messages.select(at.alias("at")), "at", [k / CUTS for k in range(CUTS + 1)])
    for k in range(CUTS):
        own = (at >= int(borders[k])) & (at <= int(borders[k + 1]) if k + 1 == CUTS else at < int(borders[k + 1]))
        messages.filter(own).coalesce(1).write.parquet(f"{folder}/cut={k}")
    return folder


# --- archives -------------------------------------------------------------

FILES_PER_ARCHIVE = 64


def _unpacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files with the ``archive`` they go into and its ``fault``."""
    block = F.floor(F.col("seq") / FILES_PER_ARCHIVE)
    number = F.regexp_extract("project_id", r"(\d+)\z", 1).cast("long") + block
    return files(spark, sf_dir).select(
        F.concat("project_id", F.lit("_"), text_of(block)).alias("archive"),
        (number % 5).alias("fault"),
        "seq",
        "rel_path",
        "content",
    )


def _zipped(group: pd.DataFrame, damage: bool) -> bytes:
    group = group.sort_values("seq")
    warnings.filterwarnings("ignore", message="Duplicate name")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
        for path, body in zip(group["rel_path"], group["content"]):
            archive.writestr(_entry(path), bytes(body))
    blob, fault = bytearray(out.getvalue()), group["fault"].iloc[0]
    if damage and fault == 1:
        blob[30 + len(group["rel_path"].iloc[0].encode())] ^= 0xFF
    if damage and fault == 2:
        blob = b"no archive: " + group["archive"].iloc[0].encode()
    return bytes(blob)


def packed(spark: SparkSession, sf_dir: str, damage: bool = False) -> DataFrame:
    """``project_id, content``: the files packed into ZIPs of at most 64 members.

    With ``damage`` two archives in five get a flipped byte or no ZIP at all.
    """

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"project_id": [group["archive"].iloc[0]], "content": [_zipped(group, damage)]})

    return _unpacked(spark, sf_dir).groupBy("archive").applyInPandas(pack, "project_id string, content binary")


def _entry(path: str) -> zipfile.ZipInfo:
    return zipfile.ZipInfo(path, date_time=(2024, 1, 1, 0, 0, 0))


def uploads(spark: SparkSession, folder: str) -> list[str]:
    """Names of the packed archives, of which there are few."""
    return [r[0] for r in list_archives(spark, folder).select("project_id").collect()]


def saved(spark: SparkSession, sf_dir: str, folder: str, damage: bool = False) -> DataFrame:
    """Writes the packed archives where they are packed, one at a time; a row of ``n`` for each."""

    def save(group: pd.DataFrame) -> pd.DataFrame:
        system, root = resolve(folder)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{group['archive'].iloc[0]}.zip") as out:
            out.write(_zipped(group, damage))
        return pd.DataFrame({"n": [1]})

    return _unpacked(spark, sf_dir).groupBy("archive").applyInPandas(save, "n long")


def archive_folder(spark: SparkSession, sf_dir: str, damage: bool = False) -> str:
    """Write the packed archives as ``.zip`` files below the shared folder."""
    folder = qualified(spark, scratch_path(spark, "archives"))
    saved(spark, sf_dir, folder, damage).agg(F.sum("n")).collect()
    return folder


def project_folder(spark: SparkSession, sf_dir: str) -> str:
    """Write the unique files as plain files below the shared folder."""
    folder = qualified(spark, scratch_path(spark, "projects"))

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = resolve(folder)
        for batch in batches:
            for project, path, content in zip(batch["project_id"], batch["rel_path"], batch["content"]):
                place = f"{root}/{project}/{path}"
                system.create_dir(place.rpartition("/")[0], recursive=True)
                with system.open_output_stream(place) as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"n": [len(batch)]})

    unique = dedupe_members(files(spark, sf_dir)).select("project_id", "rel_path", "content")
    unique.mapInPandas(save, "n long").agg(F.sum("n")).collect()
    return folder

