"""Documents: dedup, chunking, staging, text functions, sentiment and search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- ingest --------------------------------------------------------------------------------------


def new_documents(docs: DataFrame, seen: DataFrame | None = None, by: str = "content") -> DataFrame:
    """The first document (smallest id) of each key that wasn't seen; ``by`` is ``id`` or ``content`` (SHA-256)."""
    key = F.col("id") if by == "id" else F.sha2(F.coalesce("text", F.lit("")), 256)
    first = docs.withColumn("dedup_key", key).groupBy("dedup_key").agg(F.min("id").alias("id"))
    if seen is not None:
        first = first.join(seen.select("dedup_key"), "dedup_key", "left_anti")
    return docs.join(first, "id")


def chunk_sizes(limit: int, overlap_percent: int, safety_percent: int) -> tuple[int, int]:
    """(most tokens in a chunk, overlap) under a model's limit."""
    most = limit * safety_percent // 100
    return most, most * overlap_percent // 100


def tokens(text: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def truncate_tokens(text: Column, most: int) -> Column:
    """The first ``most`` tokens."""
    return F.array_join(F.slice(tokens(text), 1, most), " ")


def chunk_tokens(docs: DataFrame, most: int, overlap: int) -> DataFrame:
    """Windows of ``most`` tokens that overlap by ``overlap``; a short text is one unchanged chunk.

    A long text has ceil(n / (most - overlap)) chunks, so the last can lie inside the one before (T9).
    """
    step = most - overlap
    t = docs.withColumn("_t", tokens(F.col("text"))).withColumn("_n", F.size("_t"))
    starts = F.when(F.col("_n") <= most, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(step)))
    c = t.withColumn("total_chunks", F.size(starts)).select("*", F.posexplode(starts).alias("chunk_index", "_s"))
    body = F.when(F.col("_n") <= most, F.col("text")).otherwise(F.array_join(F.slice("_t", F.col("_s") + 1, F.lit(most)), " "))
    chunk_id = F.when(F.col("total_chunks") == 1, F.col("id")).otherwise(F.concat_ws("-", F.col("id"), F.lit("chunk"), F.col("chunk_index").cast("string")))
    return c.select("id", chunk_id.alias("chunk_id"), "chunk_index", "total_chunks", body.alias("chunk"))


def chunk_chars(docs: DataFrame, length: int, overlap: int) -> DataFrame:
    """D3: character windows with overlap that end with the text."""
    n = F.length("text")
    starts = F.when(n <= length, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(length - overlap)))
    c = docs.select("id", "text", F.posexplode(starts).alias("chunk_index", "start"))
    return c.select("id", "chunk_index", "start", F.substr("text", F.col("start") + 1, F.lit(length)).alias("chunk"))


def chunk_markdown(files: DataFrame, section_chars: int = 500, most_chars: int = 2000) -> DataFrame:
    """Sections of markdown: a new one at ``#``, at deeper headings once it is substantial, and when it is too long.

    Depends on line order within a file, so each file is folded by a small function over Arrow batches.
    """

    def fold(path: str, text: str) -> list[tuple]:
        out, section, lines, size = [], "", [], 0

        def flush() -> None:
            nonlocal lines, size
            if lines:
                out.append((path, section, len(out), "\n".join(lines).strip()))
            lines, size = [], 0

        for line in (text or "").split("\n"):
            level = len(line) - len(line.lstrip("#"))
            if level == 1 and line.startswith("# "):
                flush()
                section = line[2:].strip()
                continue
            heading = level in (2, 3) and line[level : level + 1] == " "
            if heading:
                if size > section_chars:
                    flush()
                section = line[level:].strip()
            size += len(line) + bool(lines)
            lines.append(line)
            if not heading and size > most_chars:
                flush()
        flush()
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for p, t in zip(pdf.path, pdf.text) for r in fold(p, t)], columns=["path", "section", "chunk_index", "content"])

    return files.select("path", "text").mapInPandas(run, "path string, section string, chunk_index int, content string")


def stage(docs: DataFrame) -> DataFrame:
    """Pending rows; blank texts fail at once."""
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    return docs.withColumns({"embedding_status": F.when(blank, "FAILED").otherwise("PENDING"), "retry_count": F.lit(0), "error_message": F.when(blank, F.lit("blank text"))})


def pending_batch(docs: DataFrame, size: int) -> DataFrame:
    """The oldest pending documents; a batch is a limit by nature."""
    return docs.filter("embedding_status = 'PENDING'").orderBy("id").limit(size)


def attach_vectors(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Documents with their vector, routed by the vector's collection."""
    return docs.drop("collection").join(vectors.select("id", "collection", "embedding"), "id")


# ---- text functions ------------------------------------------------------------------------------


def content_type(collection: Column, url: Column, kind: Column | None = None) -> Column:
    """F17."""
    has = lambda c, *words: F.coalesce(F.regexp_like(c, F.lit("|".join(words))), F.lit(False))
    rss = has(collection, "rss") if kind is None else has(collection, "rss") | F.coalesce(kind == "rss", F.lit(False))
    return F.when(rss, "article").when(has(collection, "wiki") | has(url, "wiki"), "documentation").when(has(collection, "cve"), "vulnerability").when(has(collection, "legal", "law"), "legal").when(has(collection, "code") | has(url, "github"), "code").otherwise("document")


def capabilities(kind: Column) -> Column:
    """What an audience can do with a content type."""
    return F.struct(kind.isin("article", "documentation", "legal").alias("human_friendly"), kind.isin("code", "documentation", "vulnerability").alias("agent_friendly"), kind.isin("code", "legal", "vulnerability").alias("structured"))


def audience(df: DataFrame, who: str) -> DataFrame:
    """Rows fit for ``human`` or ``agent``; anything else keeps all."""
    can = capabilities(F.col("content_type"))
    return df.filter(can["human_friendly"]) if who == "human" else df.filter(can["agent_friendly"]) if who == "agent" else df


def _outside_braces(text: Column) -> Column:
    """What stands in no template and no table, however deep they nest. Braces without a partner stay.

    The text is cut at the signs ``{{ }} {| |}``; one fold keeps the texts of the open levels, and a closing sign drops the
    innermost level of its kind.
    """
    parts = F.regexp_extract_all(text, F.lit(r"(?s)\{\{|\}\}|\{\||\|\}|(?:(?!\{\{|\}\}|\{\||\|\}).)+"), F.lit(0))
    # Levels from the outermost: what opened the level, and its text so far.
    level = lambda sign, text: F.struct(sign.alias("sign"), text.alias("text"))
    top = lambda levels: F.element_at(levels, -1)
    below = lambda levels: F.slice(levels, 1, F.size(levels) - 1)
    added = lambda levels, more: F.concat(below(levels), F.array(level(top(levels)["sign"], F.concat(top(levels)["text"], more))))

    def step(levels: Column, part: Column) -> Column:
        closes = F.when(part == "}}", "{{").when(part == "|}", "{|")
        return (
            F.when(part.isin("{{", "{|"), F.concat(levels, F.array(level(part, F.lit("")))))
            .when(closes.isNotNull() & (top(levels)["sign"] == closes), below(levels))
            .otherwise(added(levels, part))
        )

    start = F.array(level(F.lit(""), F.lit("")))
    done = F.aggregate(parts, start, step)
    return F.array_join(F.transform(done, lambda x: F.concat(x["sign"], x["text"])), "")


def clean_wikitext(text: Column) -> Column:
    """the prose of wiki markup.

    Comments and references go with what they hold, then templates and tables from the innermost outwards, then links to
    files, images and categories with their captions. Any other link leaves its label (its last part), an external link
    its words. Quote runs, heading signs, tags and entities are bare markup; white space becomes one space.
    """
    bare = lambda t, pattern, by="": F.regexp_replace(t, pattern, by)
    text = bare(text, r"(?s)<!--.*?-->")
    text = bare(text, r"(?is)<ref\b[^>]*?(?:/>|>.*?</ref\s*>)")
    text = _outside_braces(text)
    text = bare(text, r"(?i)\[\[\s*:?(?:file|image|category)\s*:(?:[^\[\]]|\[\[[^\[\]]*\]\])*\]\]")
    text = bare(text, r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]", "$1")
    text = bare(text, r"\[(?:https?|ftp)://[^\s\]]*\s*([^\]]*)\]", "$1")
    text = bare(text, r"(?m)^[ \t]*(={1,6})(?!=)[ \t]*(\S.*?)[ \t]*\1[ \t]*$", "$2")
    text = bare(bare(text, r"'{2,}"), r"</?[A-Za-z][^<>]*>")
    return F.trim(bare(bare(text, r"&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);", " "), r"\s+", " "))


#: What a man page loses, in order; the heading sign takes the place of a whole section line.
MANPAGE = (("\\.TH[^\n]*\n", ""), ("\\.SH[^\n]*\n", "\n### "), ("\\.[A-Z]{2}[^\n]*\n", "\n"))


def clean_manpage(text: Column, most: int = 2000) -> Column:
    """F16: a man page without its title, with a heading sign for each section line and without other requests of two
    capitals; the first ``most`` characters (the feature's own bound)."""
    return F.substring(reduce(lambda t, rule: F.regexp_replace(t, *rule), MANPAGE, text), 1, most)


def render_manpage(title: Column, kind: Column, section: Column, path: Column, content: Column, most: int = 2000) -> Column:
    """F16: a man page as text: its fields, then its clean content and, where that was longer, the length of the whole."""
    field = lambda name, c: F.concat(F.lit(f"**{name}:** "), c)
    more = F.when(F.length(content) > most, F.concat(F.lit("\n...\n*(Full content: "), F.length(content).cast("string"), F.lit(" characters)*")))
    return F.concat_ws("\n", F.concat(F.lit("# "), title), F.lit(""), field("Type", kind), field("Section", section), field("Path", path), F.lit(""), F.lit("## Content"), F.lit(""), clean_manpage(content, most), more)


def byte_size(n: Column) -> Column:
    """bytes in the largest of B, KB, MB and GB that they fill, halves rounded to even as the SQL's printf does."""
    unit = lambda k, name: F.concat(F.call_function("format_number", n / float(1024**k), F.lit("0.00")), F.lit(f" {name}"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, unit(1, "KB")).when(n < 1024**3, unit(2, "MB")).otherwise(unit(3, "GB"))


def render_torrent() -> Column:
    """a row of ``io.read_torrents`` as text."""
    created = F.when(F.col("created").isNotNull(), F.concat(F.lit("**Created:** "), F.date_format(F.timestamp_seconds("created"), "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    counts = F.concat(F.lit("**Seeders:** "), F.col("seeders").cast("string"), F.lit(" | **Leechers:** "), F.col("leechers").cast("string"), F.lit(" | **Completed:** "), F.col("completed").cast("string"))
    return F.concat_ws("\n", F.concat(F.lit("# "), "name"), F.lit(""), F.concat(F.lit("**Infohash:** "), "infohash"), F.concat(F.lit("**Size:** "), byte_size(F.col("size_bytes"))), created, counts, F.lit(""), F.concat(F.lit("**Magnet Link:** magnet:?xt=urn:btih:"), "infohash"))


def render_vulnerability(most: int = 10) -> Column:
    """a row of ``flatten_vulnerability`` as text, with its first ``most`` products and the number of the others."""
    score = F.coalesce(F.concat(F.lit(" (CVSS: "), F.col("base_score").cast("string"), F.lit(")")), F.lit(""))
    left = F.size("products") - most
    listed = F.concat(F.transform(F.slice("products", 1, most), lambda p: F.concat(F.lit("- "), p)), F.when(left > 0, F.array(F.concat(F.lit("- ... and "), left.cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>")))
    products = F.when(F.size("products") > 0, F.concat(F.lit("\n## Affected Products\n"), F.array_join(listed, "\n")))
    return F.concat_ws("\n", F.concat(F.lit("# "), "id"), F.lit(""), F.concat(F.lit("**Severity:** "), "severity", score), F.concat(F.lit("**Published:** "), "published"), F.lit(""), F.lit("## Description"), "description", products)


def json_list(text: Column) -> Column:
    """a JSON array of texts as a list, a JSON text or bare text as a list of one; null and empty text as none."""
    listed = F.from_json(text, "array<string>")
    one = F.regexp_replace(F.trim(text), r'^"(.*)"$', "$1")
    return F.when(F.coalesce(F.trim(text), F.lit("")).isin("", "null"), F.array().cast("array<string>")).when(F.startswith(F.trim(text), F.lit("[")), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(F.array(one))


def page_text(html: Column, url: Column, most: int = 10_000) -> dict[str, Column]:
    """title (heading, else title element, else the end of the address) and bare content of a page."""
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))
    h1 = bare(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    title = bare(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    body = F.regexp_replace(F.regexp_extract(html, r"(?is)<article[^>]*>(.*)", 1), r"(?is)</article>.*|<script.*?</script>|<style.*?</style>", "")
    return {"title": F.coalesce(F.nullif(h1, F.lit("")), F.nullif(title, F.lit("")), F.regexp_extract(url, r"([^/]*)$", 1)), "content": F.substring(bare(body), 1, most)}


def snippet(text: Column, n: int = 200) -> Column:
    """F20."""
    return F.substring(text, 1, n)


def parse_time(raw: Column) -> Column:
    """ISO instant, RFC 1123, then ISO with an offset; null if none fits."""
    tries = [F.lit(f) for f in ("yyyy-MM-dd'T'HH:mm:ss[.SSS]'Z'", "EEE, d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX")]
    bare = F.regexp_replace(raw, r"^[A-Za-z]{3}, ", "")
    return F.coalesce(F.try_to_timestamp(raw, tries[0]), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(raw, tries[2]))


def flatten_vulnerability(df: DataFrame) -> DataFrame:
    """F12, IO13: identifier, English text first, severity and score by the newest scoring version, references, products."""
    cvss = "array<struct<cvssData:struct<baseSeverity:string,baseScore:double,vectorString:string>>>"
    schema = f"id string, published string, descriptions array<struct<lang:string,value:string>>, metrics struct<cvssMetricV31:{cvss},cvssMetricV30:{cvss},cvssMetricV2:{cvss}>, references array<struct<url:string>>, configurations struct<nodes:array<struct<cpeMatch:array<struct<criteria:string>>>>>"
    c = df.select(F.from_json("json", schema).alias("c")).select("c.*")
    new = F.coalesce(F.get("metrics.cvssMetricV31", F.lit(0)), F.get("metrics.cvssMetricV30", F.lit(0)))["cvssData"]
    old = F.get("metrics.cvssMetricV2", F.lit(0))["cvssData"]
    old_score = old["baseScore"]
    severity = F.when(F.col("metrics.cvssMetricV31").isNotNull() | F.col("metrics.cvssMetricV30").isNotNull(), F.coalesce(new["baseSeverity"], F.lit("UNKNOWN"))).when(F.col("metrics.cvssMetricV2").isNotNull(), F.when(old_score >= 7, "HIGH").when(old_score >= 4, "MEDIUM").otherwise("LOW")).otherwise("UNKNOWN")
    parts = lambda cpe: F.split(cpe, ":")
    cpes = F.filter(F.flatten(F.transform("configurations.nodes", lambda n: F.transform(n["cpeMatch"], lambda m: m["criteria"]))), lambda x: F.size(parts(x)) >= 5)
    english = F.get(F.filter("descriptions", lambda d: d["lang"] == "en"), F.lit(0))["value"]
    return c.select(
        "id", F.coalesce(english, F.get("descriptions", F.lit(0))["value"], F.lit("")).alias("description"), severity.alias("severity"), F.coalesce(new["baseScore"], old_score).alias("base_score"), "published",
        F.array_compact(F.transform("references", lambda r: r["url"])).alias("references"), F.array_distinct(F.transform(cpes, lambda x: F.concat_ws(":", F.get(parts(x), F.lit(3)), F.get(parts(x), F.lit(4))))).alias("products"),
    )


# ---- sentiment -----------------------------------------------------------------------------------


def lexicon_sentiment(text: Column, positive: list[str], negative: list[str], scale: float = 10.0) -> dict[str, Column]:
    """``(pos - neg) / max(1, pos + neg)`` over tokens, and confidence by their number."""
    t = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-zA-Z0-9_\-]+"), F.lit(0))
    count = lambda words: F.size(F.filter(t, lambda x: x.isin(*words)))
    pos, neg = count(positive), count(negative)
    return {"sentiment_score": (pos - neg) / F.greatest(pos + neg, F.lit(1)), "confidence": F.least(F.lit(1.0), (pos + neg) / F.lit(scale))}


def pattern_sentiment(text: Column, positive: str, negative: str, scale: float = 6.0) -> dict[str, Column]:
    """The same on counts of two patterns."""
    low = F.lower(F.coalesce(text, F.lit("")))
    pos, neg = F.regexp_count(low, F.lit(positive)), F.regexp_count(low, F.lit(negative))
    return {"sentiment_score": (pos - neg) / F.greatest(pos + neg, F.lit(1)), "confidence": F.least(F.lit(1.0), (pos + neg) / F.lit(scale))}


def first_alias(text: Column, aliases: dict[str, str], default: str) -> Column:
    """The symbol of the first alias that the text contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(F.contains(low, F.lit(a)), F.lit(s)) for a, s in aliases.items()], F.lit(default))


def extract_symbols(title: Column, text: Column, tickers: list[str], aliases: dict[str, str], context: list[str], regions: dict[str, list[str]], most: int = 8) -> Column:
    """``$TICKER``, upper-case words of the title, aliases, and under context words the global and regional symbols; ordered, distinct, the first ``most``."""
    low = F.lower(F.coalesce(text, F.lit("")))
    known = lambda found: F.filter(found, lambda x: x.isin(*tickers))
    cash = known(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\$([A-Z]{2,10})"), F.lit(1)))
    upper = known(F.filter(F.split(F.coalesce(title, F.lit("")), r"\s+"), lambda x: F.regexp_like(x, F.lit("^[A-Z]{2,6}$"))))
    named = [F.when(F.contains(low, F.lit(a)), F.lit(s)) for a, s in aliases.items()]
    about = F.regexp_like(low, F.lit("|".join(context)))
    wide = [F.when(about, F.lit("CRYPTO_GLOBAL")), *[F.when(about & F.regexp_like(low, F.lit("|".join(words))), F.lit(s)) for s, words in regions.items()]]
    return F.slice(F.array_distinct(F.concat(cash, upper, F.array_compact(F.array(*named, *wide)))), 1, most)


def sentiment_rows(docs: DataFrame, symbols: Column) -> DataFrame:
    """One row a symbol of each first chunk; scores clamped, label by score. ``model_score`` and ``model_confidence`` are input columns."""
    first = docs.filter(F.coalesce(F.expr("try_cast(metadata['chunk_index'] AS INT)"), F.lit(0)) <= 0)
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("model_score")))
    label = F.when(score >= 0.2, "bullish").when(score <= -0.2, "bearish").otherwise("neutral")
    named = lambda k: F.nullif(F.trim(F.col("metadata")[k]), F.lit(""))
    return first.withColumn("symbol", F.explode(symbols)).select(
        F.coalesce(parse_time(F.col("metadata")["published_date"]), F.col("created_at")).alias("observed_at"), "symbol", F.coalesce(named("feed_title"), named("feed_url"), F.lit("rss")).alias("source"),
        named("title").alias("article_title"), named("link").alias("article_url"), score.alias("sentiment_score"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("model_confidence"))).alias("confidence"), label.alias("sentiment_label"), F.col("id").alias("doc_id"),
    )


# ---- search --------------------------------------------------------------------------------------


def vector_top_k(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The nearest by cosine in each collection, then overall; ties by id. A top-k report.

    Each collection keeps k rows by a window whose rank limit Spark applies before the shuffle.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = sum(x * x for x in map(float, query)) ** 0.5
    e = F.col("embedding")
    scored = vectors.select("id", "collection", (dot(e, q) / (F.sqrt(dot(e, e)) * norm)).alias("score"))
    own = Window.partitionBy("collection").orderBy(F.desc("score"), "id")
    best = scored.withColumn("_r", F.row_number().over(own)).filter(F.col("_r") <= k).drop("_r").orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def fuse(vector_hits: DataFrame, text_hits: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists with a ``key``, ranks from 1 (T17); the vector row's fields win."""
    v = vector_hits.select("key", "collection", "rank", F.lit(0).alias("_s"))
    t = text_hits.select("key", "collection", "rank", F.lit(1).alias("_s"))
    g = v.union(t).groupBy("key").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"), F.min_by("collection", "_s").alias("collection"), F.count("*").alias("lists"))
    return g.orderBy(F.desc("score"), "key").limit(k)
