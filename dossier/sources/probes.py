"""What unknown pages hold: kinds of links, fields by keyword, pagination, words inside and outside scripts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.functions import urls
from dossier.functions.canonical import casefolded, nfc
from dossier.functions.text import collapsed
from dossier.sources.html import links
from dossier.store import spread

# Extensions of documents, words of download addresses, and how scripts go to another page or send a form.
DOCUMENT_EXTENSIONS = ("pdf", "doc", "docx", "xls", "xlsx", "zip", "rar", "7z", "odt", "ods", "rtf", "txt", "csv")
DOWNLOAD_WORDS = ("download", "attachment", "getfile", "fileid", "documentid")
JS_NAVIGATION = r"(?i)(?:window\.|document\.)?location(?:\.href)?\s*=|location\.(?:replace|assign)\s*\(|window\.open\s*\("
JS_SUBMIT = r"(?i)\.submit\s*\("


def absolute(href: Column, base: Column) -> Column:
    """A link's target seen from its page: full URLs stay, others go to the host's root or the page's folder."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*(?:/.*/|/)?)", 1)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), href))
    )


def document_extension(url: Column, text: Column) -> Column:
    """The first document extension in a URL's path, its query, or the link's text."""
    pattern = rf"(?i)\.({'|'.join(DOCUMENT_EXTENSIONS)})(?=$|[&\s\"'])"
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    found = [F.nullif(F.lower(F.regexp_extract(c, pattern, 1)), F.lit("")) for c in (urls.base_name(url), query, text)]
    return F.coalesce(*found)


def classified_links(pages: DataFrame, page_nodes: DataFrame, key: str, url: str) -> DataFrame:
    """key, node, target, text, kind of each link: document (with extension), document_hint (by a word in the URL), other, or script."""
    found = links(page_nodes, key).join(pages.select(key, F.col(url).alias("_base")), key)
    script = (F.col("href") == "") | F.col("href").startswith("#") | F.lower("href").rlike("^(javascript|mailto):")
    target = F.when(~script, absolute(F.col("href"), F.col("_base")))
    extension = document_extension(target, F.col("text"))
    hint = F.lower(target).rlike("|".join(DOWNLOAD_WORDS))
    kind = F.when(script, "script").when(extension.isNotNull(), "document").when(hint, "document_hint").otherwise("other")
    return found.select(key, "node", target.alias("target"), "text", extension.alias("extension"), kind.alias("kind"))


def keyword_fields(page_nodes: DataFrame, key: str, label_tags: Sequence[str], words: dict[str, Sequence[str]], most: int = 3) -> DataFrame:
    """key, field, label: up to most labels of a page that hold one of a field's words, in page order."""
    said = F.lower(collapsed(F.col("text")))
    rows = page_nodes.where(F.col("tag").isin(*label_tags)).select(key, "node", collapsed(F.col("text")).alias("label"), said.alias("_said"))
    named = F.filter(F.array(*(F.when(F.col("_said").rlike("|".join(w)), F.lit(field)) for field, w in words.items())), lambda x: x.isNotNull())
    matched = rows.select(key, "node", "label", F.explode(named).alias("field"))
    grouped = matched.groupBy(key, "field").agg(F.slice(F.array_sort(F.collect_list(F.struct("node", "label"))), 1, most).alias("f"))
    return grouped.select(key, "field", F.explode("f.label").alias("label"))


def pagination(page_nodes: DataFrame, key: str, pattern: str) -> DataFrame:
    """key, last_page, second_url: the largest page number among a page's links and the link to page 2; pattern's first group is the number."""
    number = F.regexp_extract("href", pattern, 1).try_cast("int")
    found = links(page_nodes, key).withColumn("_n", number).where("_n IS NOT NULL")
    return found.groupBy(key).agg(F.max("_n").alias("last_page"), F.min_by(F.when(F.col("_n") == 2, F.col("href")), F.when(F.col("_n") == 2, F.col("node"))).alias("second_url"))


def word_counts(html: Column, words: Sequence[str]) -> list[Column]:
    """For each word in_scripts_<word> and outside_<word>: how often it occurs inside and outside of scripts."""
    scripts = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<script\b.*?</script>"), F.lit(0)), "\n")
    rest = F.regexp_replace(html, r"(?is)<script\b.*?</script>", "")
    out = []
    for w in words:
        out += [F.regexp_count(scripts, F.lit(w)).alias(f"in_scripts_{w}"), F.regexp_count(rest, F.lit(w)).alias(f"outside_{w}")]
    return out


def file_name_key(c: Column) -> Column:
    """Names that differ in the kind of white space, case and Unicode form only have one key."""
    return casefolded(collapsed(nfc(c)))


def matched_names(listed: DataFrame, on_page: DataFrame, key: str, name: str) -> DataFrame:
    """Listed file names with on_page: whether the page shows them."""
    shown = on_page.select(key, file_name_key(F.col(name)).alias("_k")).distinct().withColumn("_shown", F.lit(True))
    joined = listed.withColumn("_k", file_name_key(F.col(name))).join(shown, [key, "_k"], "left")
    return joined.withColumn("on_page", F.coalesce("_shown", F.lit(False))).drop("_k", "_shown")


def endpoints(html: Column, pattern: str) -> Column:
    """The distinct places of a page's source that look like addresses of services, in order of the alphabet."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(0))))


def next_steps(page_nodes: DataFrame, pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, kind, detail of what a page would have a browser do: form_post and form_get with their action, refresh with seconds and target, onload, js_navigation and js_submit with their numbers."""
    attribute = lambda name: F.coalesce(F.col("attrs")[name], F.lit(""))
    refresh = (F.col("tag") == "meta") & (F.lower(attribute("http-equiv")) == "refresh")
    kind = F.when(F.col("tag") == "form", F.when(F.lower(attribute("method")) == "post", "form_post").otherwise("form_get")).when(refresh, "refresh").when((F.col("tag") == "body") & (attribute("onload") != ""), "onload")
    target = F.regexp_replace(attribute("content"), r"(?i)^\s*(\d+)\s*;\s*url\s*=\s*['\"]?([^'\"]*)['\"]?\s*$", "$1 $2")
    detail = F.when(F.col("tag") == "form", attribute("action")).when(refresh, target).otherwise(attribute("onload"))
    marked = page_nodes.select(key, kind.alias("kind"), detail.alias("detail")).where("kind IS NOT NULL")
    scripts = F.array_join(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<script\b.*?</script>"), F.lit(0)), "\n")
    counts = F.array(F.struct(F.lit("js_navigation").alias("kind"), F.regexp_count(scripts, F.lit(JS_NAVIGATION)).alias("n")), F.struct(F.lit("js_submit").alias("kind"), F.regexp_count(scripts, F.lit(JS_SUBMIT)).alias("n")))
    said = pages.select(key, F.explode(counts).alias("c")).select(key, "c.kind", F.col("c.n").cast("string").alias("detail")).where("detail <> '0'")
    return marked.unionByName(said)


def found_fields(page_nodes: DataFrame, key: str, words: dict[str, Sequence[str]], most: int = 3, most_text: int = 150) -> DataFrame:
    """key, field, label, value, via: up to most finds of each field of a page, each label and value once.

    Pairs of a dt and its dd, or of the two cells of a row, whose label holds one of the words; a short text that holds
    one counts, without a value, only where no pair does.  page_nodes are all elements of a page; one shuffle by pages, no joins.
    """
    rows = spread(page_nodes.select(key, "node", "parent", "last", "tag", collapsed(F.col("text")).alias("label")), key)
    paired = F.col("tag").isin("dt", "dd", "td")
    rows = rows.withColumn("_of", F.when(paired, F.col("parent")).otherwise(-2))  # other nodes come between no pair
    siblings = W.partitionBy(key, "_of").orderBy("node")
    after, n = F.lead(F.struct("tag", "label")).over(siblings), F.count_if(F.col("tag") == "td").over(W.partitionBy(key, "_of"))
    via = F.when((F.col("tag") == "dt") & (after["tag"] == "dd"), "dt/dd").when((F.col("tag") == "td") & (n == 2) & (F.row_number().over(siblings) == 1), "tr")
    pair = F.struct(after["label"].alias("value"), via.alias("via"))
    is_text = (F.col("last") == F.col("node")) & ~F.col("tag").isin("title", "noscript") & F.length("label").between(1, most_text)
    alone = F.when(is_text, F.struct(F.lit(None).cast("string").alias("value"), F.lit("text").alias("via")))
    named = F.filter(F.array(*(F.when(F.lower("label").rlike("|".join(w)), F.lit(field)) for field, w in words.items())), lambda x: x.isNotNull())
    finds = rows.select(key, "node", "label", F.filter(F.array(pair, alone), lambda x: x["via"].isNotNull()).alias("_finds"), named.alias("_named")).where("size(_finds) > 0 AND size(_named) > 0")
    finds = finds.select(key, "node", "label", "_named", F.explode("_finds").alias("_find")).select(key, "node", "label", "_find.*", F.explode("_named").alias("field"))
    finds = finds.withColumn("_paired", F.max(F.col("via") != "text").over(W.partitionBy(key, "field"))).where("via <> 'text' OR NOT _paired")
    once = finds.groupBy(key, "field", "label", "value", "via").agg(F.min("node").alias("node"))
    nth = F.row_number().over(W.partitionBy(key, "field").orderBy("node"))
    return once.withColumn("_nth", nth).where(F.col("_nth") <= most).select(key, "field", "label", "value", "via")
