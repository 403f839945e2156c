"""Column functions built from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body of a value that is worked out once; a lambda works out all but its own arguments anew for each element."""
    return F.transform(F.array(value), body)[0]


def clean(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(x, r"(?U)\s+", " "))


def squash(x: Column) -> Column:
    """Without any white space, characters as they are; text.squashed folds them too."""
    return F.regexp_replace(x, r"(?U)\s+", "")


# Years, dates, part numbers and marks that titles differ in.
TITLE_NOISE = r"(?U)(?:19|20)\d{2}年度?|(?:19|20)\d{6}|第?\d+編|[\s　_・／/（）\(\)【】「」、,\.：:～~\-－—]"


def title_norm(x: Column) -> Column:
    """A title as it is compared with others."""
    from lexspark.functions.text import nfkc_column

    return F.regexp_replace(nfkc_column(x), TITLE_NOISE, "")


def title_and_size(x: Column) -> Column:
    """title and size of a link text that ends in the file's size; the whole text and null where it doesn't."""
    # Fixed value: how the size is written.
    pattern = r"^(.*?)\s*[（(]PDF[：:]\s*([\d.]+\s*[KMG]?B)\s*[）)]\s*$"
    fits = x.rlike(pattern)
    return F.struct(F.when(fits, clean(F.regexp_extract(x, pattern, 1))).otherwise(x).alias("title"), F.when(fits, clean(F.regexp_extract(x, pattern, 2))).alias("size"))


def is_rule_change(classifications: Column) -> Column:
    return F.coalesce(F.array_contains(classifications, "規則変更"), F.lit(False))


def is_comparison(x: Column) -> Column:
    return F.coalesce(x.rlike("対比表|対照表|新旧"), F.lit(False))


def notice_number(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"公示\s*No\.?\s*([0-9A-Za-z‐-―\-]+)", 1), F.lit(""))


_N, _K = "[0-9０-９]", "[0-9０-９一二三四五六七八九十]"
# Marks that open a heading, with its level and the longest text; the first that fits decides.
HEADING_MARKS = [
    (rf"^第\s*{_K}+\s*編", 1, 40),
    (rf"^第\s*{_K}+\s*部", 1, 40),
    (rf"^第\s*{_K}+\s*章", 2, 40),
    (rf"^第\s*{_K}+\s*節", 3, 60),
    (rf"^第\s*{_N}+\s*条", 4, 60),
    (r"^(附\s*則|付\s*則|別\s*表|別\s*紙|付\s*表|付\s*録|参\s*考)", 2, 40),
    (rf"^{_N}+\s*[-－‐]\s*{_N}+\s*[-－‐]\s*{_N}+", 5, 30),
    (rf"^{_N}+\s*[-－‐]\s*{_N}+", 5, 30),
    (rf"^{_N}+\s*[.．]\s*{_N}+", 5, 30),
    (rf"^{_N}+\s*[.．]\s*\S", 5, 30),
]


def caption(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^\s*[（(]?\s*(図|表|写真|Fig|Table|参考図|付図)\s*[0-9０-９\-－.]*"), F.lit(False))


def clause_number(x: Column) -> Column:
    """The number that opens a clause, without white space; null if none does."""
    found = F.regexp_extract(x, rf"^\s*(第\s*{_K}+\s*[編章節条]|{_N}+(?:\s*[.．\-－]\s*{_N}+)*\s*[）)]?)", 1)
    return F.nullif(squash(found), F.lit(""))


def garbled_share(x: Column) -> Column:
    """Share of replacement and private-use characters; 0 of an empty text."""
    bad = F.length(x) - F.length(F.regexp_replace(x, "[\ufffd\ue000-\uf8ff]", ""))
    return F.when(F.length(x) > 0, bad / F.length(x)).otherwise(0.0)


def needs_ocr(chars: Column, raster_cover: Column, garbled: Column) -> Column:
    return ((chars < 40) & (raster_cover > 0.45)) | (garbled > 0.2)


def safe_id(x: Column) -> Column:
    """No path signs and no parent folder in an id."""
    return F.coalesce((x != "") & ~x.rlike(r"[/\\\x00]") & ~F.contains(x, F.lit("..")), F.lit(False))


def url_quoted(x: Column, keep_slash: bool = True) -> Column:
    out = F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    return F.replace(out, F.lit("%2F"), F.lit("/")) if keep_slash else out


def page_url(pdf_url: Column, page: Column) -> Column:
    """The address of a page of a file; the file's own where the page is unknown, null where the file is."""
    return F.when(pdf_url.isNull() | (pdf_url == "") | page.isNull() | (page == 0), pdf_url).otherwise(F.concat(pdf_url, F.lit("#page="), page.cast("string")))


def answer_key(question: Column, model: Column, dim: Column, version: Column) -> Column:
    """Digest under which an answer is kept: the folded question, the model and the data's version."""
    from lexspark.functions.text import normalised

    return F.sha2(F.concat_ws("\u0000", F.lower(normalised(question)), model, dim.cast("string"), version), 256)


def citations(x: Column) -> Column:
    """Numbers in square brackets, in order, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(r"\[(\d{1,2})\]"), F.lit(1)), lambda n: n.cast("int")))


def clip(x: Column, limit: int) -> Column:
    """At most `limit` characters; a cut text loses trailing separators and ends in an ellipsis."""
    cut = F.regexp_replace(F.substring(x, 1, limit - 1), "[／、。 ]+$", "")
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(cut, F.lit("…")))


def falsy(x: Column, default) -> Column:
    """x, or the default where x is null, empty or zero."""
    return F.when(x.isNull() | (x.cast("string").isin("", "0", "0.0")), default).otherwise(x)


def japanese_date(x: Column) -> Column:
    """ISO date of the first year-month-day with Japanese marks; null if there is none."""
    part = lambda k: F.regexp_extract(x, r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", k).try_cast("int")
    return F.when(part(1).isNotNull(), F.format_string("%04d-%02d-%02d", part(1), part(2), part(3)))


def comma_list(x: Column) -> Column:
    """Parts between commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda p: F.btrim(p)), lambda p: p != "")


def series_key(doc_id: Column) -> Column:
    """Id without its hash, two-digit suffix, trailing date and leading year, taken off in this order."""
    x = F.regexp_replace(doc_id, "-[0-9a-f]{6}$", "")
    x = F.regexp_replace(x, r"-\d{2}$", "")
    x = F.regexp_replace(x, r"_(19|20)\d{6}$", "")
    return F.regexp_replace(x, r"^(19|20)\d{2}_", "")


def effective_date(doc_id: Column, title: Column) -> Column:
    """The last plausible YYYYMMDD of the id, else of the title, as an ISO date."""

    def last(x: Column) -> Column:
        found = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(?:19|20)\d{6}"), F.lit(0))
        good = F.filter(found, lambda d: F.substring(d, 5, 2).between("01", "12") & F.substring(d, 7, 2).between("01", "31"))
        d = F.try_element_at(good, F.lit(-1))
        return F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))

    return F.coalesce(F.nullif(last(doc_id), F.lit("")), F.nullif(last(title), F.lit("")))


def edition_label(doc_id: Column, title: Column) -> Column:
    """Year at the start of the title, else of the effective date, else of the id, else empty."""
    lead = lambda x: F.nullif(F.regexp_extract(F.coalesce(x, F.lit("")), r"^((?:19|20)\d{2})", 1), F.lit(""))
    return F.coalesce(lead(title), F.substring(effective_date(doc_id, title), 1, 4), lead(doc_id), F.lit(""))


def document_id(url: Column) -> Column:
    """Stable id of a file's address: cleaned file name and six digits of the path's SHA-1."""
    path = F.split_part(url, F.lit("?"), F.lit(1))
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.pdf$", "")
    name = F.regexp_replace(F.regexp_replace(name, "[^0-9A-Za-z_-]+", "-"), "^-+|-+$", "")
    return F.concat(F.substring(F.lower(name), 1, 60), F.lit("-"), F.substring(F.sha1(path), 1, 6))


def display_title(x: Column) -> Column:
    return F.regexp_replace(x, r"[_\-]\d{8}$", "")


def year_masked(x: Column) -> Column:
    return F.regexp_replace(x, r"(?:19|20)\d{2}", "YYYY")


def running_key(x: Column) -> Column:
    """Text of a running line: without white space, digits as #, 60 characters."""
    return F.substring(F.regexp_replace(squash(x), "[0-9０-９]+", "#"), 1, 60)


def occurrences(text: Column, term: str) -> Column:
    """Overlapping occurrences of a term in a text, in one pass."""
    return F.regexp_count(text, F.lit("(?=" + "".join(rf"\x{{{ord(c):x}}}" for c in term) + ")(?s:.)"))


def trigrams(text: Column) -> Column:
    """All runs of three characters, in one pass."""
    return F.regexp_extract_all(text, F.lit("(?s)(?=(...))."), F.lit(1))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Vector of length one; a zero vector stays."""
    norm = F.sqrt(inner_product(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


# Words of no use in a query.
STOPWORDS = ["場合", "以下", "以上", "とき", "こと", "もの", "ため", "regulations", "jaf"]
# Runs of one script, in order of preference; hiragana runs are dropped.
TERM_RUNS = r"[ァ-ヴー]+|[一-龠々]+|[A-Za-z][A-Za-z0-9.\-]*|[0-9]+(?:[.,][0-9]+)*[A-Za-z]*"


def query_terms(question: Column) -> Column:
    """Terms of a question: runs of one script, two characters at least, first occurrence, longest first."""
    found = F.regexp_extract_all(question, F.lit(TERM_RUNS), F.lit(0))
    kept = F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 2) & ~F.lower(t).isin(STOPWORDS)))
    ordered = F.array_sort(F.transform(kept, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t"))))
    return F.transform(ordered, lambda x: x["t"])


def tolerant_list(x: Column, schema: str = "array<string>") -> Column:
    """JSON array in text; empty where it is null or broken."""
    return F.coalesce(F.from_json(x, schema), F.array().cast(schema))
