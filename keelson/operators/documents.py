"""Documents: retained revisions by content, logs of uploads, listings, and texts in pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import content_id, safe_name
from ..sources.store import scratch
from .events import first_by

# What may be uploaded, and how large; the characters of a chunk of pages.
EXTENSIONS = ("pdf", "xer", "xlsx", "xml", "txt", "csv", "png", "jpg", "jpeg")
MAX_BYTES = 20 << 20
CHUNK_CHARS = 6000


def retained(files: DataFrame, content: str = "content") -> DataFrame:
    """One row a distinct content, with its id; keeping a content again changes nothing."""
    return files.withColumn("version_id", content_id(F.col(content))).dropDuplicates(["version_id"])


def version_listing(versions: DataFrame, log: DataFrame, live: Column, seeds: list[str] | None = None) -> DataFrame:
    """Versions with their first log entry, the live one first and then the newest.

    ``versions`` (version_id, kept_at), ``log`` (version_id, ts, uploaded_by,
    original_name). What is live or a seed can't be deleted.
    """
    first = first_by(log, ["version_id"], F.col("ts").asc()).select("version_id", F.col("ts").alias("logged_at"), "uploaded_by", "original_name")
    joined = versions.join(first, "version_id", "left").withColumns({"live": F.coalesce(F.col("version_id") == live, F.lit(False)), "at": F.coalesce("logged_at", "kept_at")})
    seed = F.col("version_id").isin(*seeds) if seeds else F.lit(False)
    return joined.withColumn("deletable", ~F.col("live") & ~seed).drop("logged_at", "kept_at").orderBy(F.col("live").desc(), F.col("at").desc(), "version_id")


def deleted(versions: DataFrame, log: DataFrame, version: str, live: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without a version; the live one can't go."""
    if version == live:
        raise ValueError("the live revision can't be deleted")
    return versions.where(F.col("version_id") != version), log.where(~F.coalesce(F.col("version_id") == version, F.lit(False)))


def activated(versions: DataFrame, log: DataFrame, version: str, live: str | None, by: str, at: Column) -> DataFrame:
    """The log after a revision is made the live one; nothing is added if it is already. An unknown one is an error."""
    if version == live:
        return log
    if versions.where(F.col("version_id") == version).isEmpty():
        raise ValueError(f"no such revision: {version}")
    entry = log.sparkSession.range(1).select(F.lit(version).alias("version_id"), at.alias("ts"), F.lit(by).alias("uploaded_by"), F.lit(f"activated {version}").alias("original_name"))
    return log.unionByName(entry, allowMissingColumns=True)


def with_seeds(versions: DataFrame, seeds: DataFrame) -> DataFrame:
    """Versions and the bundled ones that are missing: seeds that were deleted return in the next listing."""
    return versions.unionByName(seeds.join(versions.select("version_id"), "version_id", "left_anti"), allowMissingColumns=True)


def active_revision(files: DataFrame, assets: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with the ``revision`` of the asset (revision, content) of the same bytes, or 'unknown'."""
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    known = assets.groupBy(digest(content).alias("__digest")).agg(F.min("revision").alias("revision"))
    return files.withColumn("__digest", digest(content)).join(known, "__digest", "left").withColumn("revision", F.coalesce("revision", F.lit("unknown"))).drop("__digest")


def upload_histories(documents: DataFrame, log: DataFrame) -> DataFrame:
    """Documents by name with all their uploads, the newest first."""
    entry = F.struct("ts", "uploaded_by", "version_id")
    every = log.groupBy("name").agg(F.sort_array(F.collect_list(entry), asc=False).alias("history"))
    return documents.join(every, "name", "left").withColumn("history", F.coalesce("history", F.array().cast(every.schema["history"].dataType))).orderBy("name")


def upload_fault(name: Column, content: Column) -> Column:
    """Why an upload is refused; null if it isn't."""
    extension = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(safe_name(name) != name, "unsafe name")
        .when(~extension.isin(*EXTENSIONS), "extension not allowed")
        .when(F.octet_length(content) > MAX_BYTES, "larger than 20 MB")
        .when((extension == "pdf") & (F.substring(content, 1, 4) != F.lit(b"%PDF")), "no PDF")
    )


def upload_kind(name: Column, content: Column, text: Column, tag: str) -> Column:
    """'submittal' for a PDF whose text names the tag, else 'reference'."""
    pdf = F.substring(content, 1, 4) == F.lit(b"%PDF")
    return F.when(pdf & F.contains(F.coalesce(text, F.lit("")), F.lit(tag)), "submittal").otherwise("reference")


def without_duplicates(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The first row of each key."""
    return first_by(rows, keys, F.col(order).asc())


def page_chunks(pages: DataFrame, budget: int = CHUNK_CHARS) -> DataFrame:
    """``doc_id, chunk, first_page, last_page, chars``: pages in order, greedily up to a budget of characters.

    ``pages`` (doc_id, page, text); empty pages are left out, and a longer page
    is a chunk of its own. The running sum starts again with each chunk, which a
    window can't do; a fold over a document's page lengths does.
    """
    sizes = pages.where(F.length("text") > 0).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", F.length("text").alias("n")))).alias("p"))
    empty = F.array().cast("array<struct<first_page:int,last_page:int,chars:int>>")
    start = F.struct(empty.alias("done"), F.lit(None).cast("struct<first_page:int,last_page:int,chars:int>").alias("open"))

    def add(state: Column, page: Column) -> Column:
        number, n = page["page"].cast("int"), page["n"].cast("int")
        full = state["open"].isNotNull() & (state["open"]["chars"] + n > budget)
        fresh = F.struct(number.alias("first_page"), number.alias("last_page"), n.alias("chars"))
        grown = F.struct(state["open"]["first_page"].alias("first_page"), number.alias("last_page"), (state["open"]["chars"] + n).alias("chars"))
        done = F.when(full, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])
        return F.struct(done.alias("done"), F.when(full | state["open"].isNull(), fresh).otherwise(grown).alias("open"))

    folded = sizes.select("doc_id", F.aggregate("p", start, add, lambda s: F.concat(s["done"], F.array(s["open"]))).alias("chunks"))
    return folded.select("doc_id", F.posexplode("chunks").alias("chunk", "c")).select("doc_id", "chunk", "c.*")


#: Characters of the grams that names are found by (a shorter name is one gram), and of the chunks that texts are cut to.
GRAM, CHUNK = 4, 4096


def _grams(text: Column, sizes: list[int]) -> Column:
    """The distinct grams of a text: its characters are split once (and bound to a name for that), so this is linear in it."""

    def of_letters(letters: Column) -> Column:
        def of_size(k: int) -> Column:
            starts = F.when(F.size(letters) >= k, F.sequence(F.lit(0), F.size(letters) - k)).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.concat(*(F.get(letters, i + j) for j in range(k))))

        return F.concat(*map(of_size, sizes))

    return F.array_distinct(F.get(F.transform(F.array(F.split(text, "")), of_letters), F.lit(0)))


def _anchors(names: DataFrame) -> DataFrame:
    """``name, gram``: of each distinct name the gram that the fewest names have, and of these the first."""
    short = F.length("name") < GRAM
    grams = F.when(short, F.array("name")).otherwise(_grams(F.col("name"), [GRAM]))
    each = names.select("name", F.explode(grams).alias("gram"))
    common = each.groupBy("gram").agg(F.count("*").alias("n"))
    return first_by(each.join(common, "gram"), ["name"], F.col("n").asc(), F.col("gram").asc()).select("name", "gram")


def occurring(texts: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """Rows of ``texts`` beside each row of ``names`` whose ``name`` the text contains, anywhere.

    Names are indexed by their rarest gram. Texts are cut to overlapping chunks,
    whose grams are joined with the index by equality, and what that finds is
    tested in its chunk: work is linear in the texts, however long one is, and
    grows with the names that share a gram, not with all. Repeated rows of either
    side stay, nulls contain nothing, and empty and null names occur nowhere.
    """
    known = scratch(_anchors(names.where(F.length(name) > 0).select(F.col(name).alias("name")).distinct()), "anchors")
    longest, sizes = known.agg(F.max(F.length("name")), F.array_sort(F.collect_set(F.length("gram")))).first()  # up to GRAM sizes
    if not sizes:
        return texts.join(names, F.lit(False))
    size = max(CHUNK, longest)
    rows = scratch(texts.withColumn("__row", F.monotonically_increasing_id()), "texts")
    parts = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    over = lambda own: F.transform(own, lambda x, i: F.concat(x, F.substring(F.coalesce(F.get(own, i + 1), F.lit("")), 1, longest - 1)))
    chunks = rows.where(F.length(text) > 0).select("__row", F.explode(F.flatten(F.transform(F.array(parts), over))).alias("__chunk"))
    found = chunks.select("__row", "__chunk", F.explode(_grams(F.col("__chunk"), list(sizes))).alias("gram")).join(known, "gram").where(F.contains("__chunk", "name"))
    pairs = found.select("__row", F.col("name").alias("__name")).distinct()
    return rows.join(pairs, "__row").join(names, F.col("__name") == F.col(name)).drop("__row", "__name")


def clause_texts(clauses: DataFrame, pages: DataFrame) -> DataFrame:
    """``clause_id, page, source_text``: of the first page that contains the clause's id, the first such line and the two after it."""
    lines = pages.select("page", F.split("text", "\r?\n").alias("lines")).select("page", F.posexplode("lines").alias("at", "line"), "lines")
    hits = occurring(lines, "line", clauses.select("clause_id").distinct(), "clause_id")
    first = first_by(hits, ["clause_id"], F.col("page").asc(), F.col("at").asc())
    return first.select("clause_id", "page", F.substring(F.trim(F.array_join(F.slice("lines", F.col("at") + 1, 3), " ")), 1, 400).alias("source_text"))


def needs_ocr(text: Column, least: int = 40) -> Column:
    """Pages with less text than this are scanned images."""
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < least


def matching_tables(tables: DataFrame, patterns: list[str], min_rows: int = 2) -> DataFrame:
    """Tables (``rows`` array of arrays) of which the text matches every pattern."""
    flat = F.array_join(F.flatten("rows"), " ")
    test = F.size("rows") >= min_rows
    for pattern in patterns:
        test = test & F.coalesce(flat.rlike(f"(?i){pattern}"), F.lit(False))
    return tables.where(test)


def full_text(pages: DataFrame) -> DataFrame:
    """Each document's pages joined in order."""
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n").alias("text"))
