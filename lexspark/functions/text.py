"""Functions on one text that Spark has none of its own for, and their column forms by Arrow batches."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

BEFORE, AFTER, LABEL = 120, 220, 42
OPEN, CLOSE, GAP = "\x01", "\x02", "…"
# A clause mark at the start of a normalised line, which white space must follow.
CLAUSE_LINE = re.compile(r"^(?:第\s*[0-9０-９]+\s*[条章編節項]|[0-9０-９]+(?:[.．][0-9０-９]+)*\s*[)）])[\s　]")


def nfkc(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text or "")


@F.pandas_udf(StringType())
def nfkc_column(texts: pd.Series) -> pd.Series:
    return texts.map(nfkc)


def squashed(x: Column) -> Column:
    """Compatibility form without any white space."""
    return F.regexp_replace(nfkc_column(x), r"(?U)\s+", "")


def normalised(x: Column) -> Column:
    """Compatibility form, runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(nfkc_column(x), r"(?U)\s+", " "))


class _Folds(dict):
    """Compatibility form in one case of each code point, worked out when it is first met."""

    def __missing__(self, code: int) -> str:
        self[code] = out = nfkc(chr(code)).casefold()
        return out


_FOLDS = _Folds()


class Folded:
    """A text's compatibility form in one case, with the original place of each of its characters."""

    def __init__(self, text: str):
        self.form = text.translate(_FOLDS)
        # no form is empty: where the lengths agree, each character has one
        self.place = range(len(text)) if len(self.form) == len(text) else np.repeat(np.arange(len(text)), np.fromiter((len(_FOLDS[ord(c)]) for c in text), np.int64, len(text)))

    def spans(self, terms: list[str]) -> list[tuple[int, int]]:
        """(begin, end) in the original of every occurrence of the terms; of those that overlap the first."""
        wanted = [re.escape(form) for form in (nfkc(t).casefold() for t in terms) if form]
        found = sorted((int(self.place[m.start()]), int(self.place[m.end() - 1]) + 1) for w in wanted for m in re.finditer(w, self.form))
        free, kept = 0, []
        for begin, end in found:
            if begin >= free:
                kept.append((begin, end))
                free = end
        return kept


def first_match(text: str | None, terms: list[str]) -> int | None:
    found = Folded(text or "").spans(terms)
    return found[0][0] if found else None


def excerpt(text: str | None, terms: list[str], before: int = BEFORE, after: int = AFTER) -> str:
    """Window around the first match, the matches that lie whole in it marked; the head of the text if nothing matches."""
    text = text or ""
    found = Folded(text).spans(terms)
    begin = max(0, found[0][0] - before) if found else 0
    end = min(len(text), found[0][0] + after if found else before + after)
    edges = [begin, *(x for span in found if span[1] <= end for x in span), end]
    shown = "".join(OPEN + text[a:b] + CLOSE if k % 2 else text[a:b] for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))
    return (GAP + " " if begin else "") + shown + (" " + GAP if end < len(text) else "")


def clause_at(text: str | None, offset: int | None, heading: str | None = None) -> str | None:
    """The nearest clause line that begins at or before an offset; not the inherited first line, not a table row."""
    lines = (text or "").split("\n")
    begins = np.cumsum([0, *(len(x) + 1 for x in lines[:-1])])
    reach = int(np.searchsorted(begins, -1 if offset is None else offset, "right"))
    inherited = bool(heading) and lines[0].strip() == heading.strip()
    for line in reversed(lines[inherited:reach] if inherited else lines[:reach]):
        if " | " not in line and CLAUSE_LINE.match(nfkc(line.strip())):
            label = " ".join(line.split())
            return label if len(label) <= LABEL else label[:LABEL] + GAP
    return None


# Ideographs and kana, and closing marks.
_WIDE, _CLOSING = "\u3000-\u30ff\u4e00-\u9fff", "、。）」"
_SEAM = re.compile(rf"(?<=[{_WIDE}{_CLOSING}])\n|\n(?=[{_WIDE}])")


def join_lines(lines: list[str]) -> str:
    """Lines as one text: no space beside ideographs, kana and closing marks."""
    whole = "\n".join(x for x in (line.rstrip() for line in lines) if x)
    return _SEAM.sub("", whole).replace("\n", " ").strip()


def joined_lines(lines: Column) -> Column:
    """join_lines of an array of lines without line ends, in the JVM."""
    kept = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), lambda x: x != "")
    seams = F.regexp_replace(F.array_join(kept, "\n"), rf"(?<=[{_WIDE}{_CLOSING}])\n|\n(?=[{_WIDE}])", "")
    return F.btrim(F.replace(seams, F.lit("\n"), F.lit(" ")))


def similarity(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def line_diff(old: str, new: str) -> list[tuple[str, str]]:
    """(op, line) of deleted and added lines; a line ends at a line feed and nothing else."""
    out = []
    a, b = old.split("\n"), new.split("\n")
    for op, i, j, p, q in difflib.SequenceMatcher(None, a, b).get_opcodes():
        if op != "equal":
            out += [("del", x) for x in a[i:j]] + [("add", x) for x in b[p:q]]
    return out


# Characters whose compatibility form in one case is their lower case, one character, wherever they stand.
PLAIN = "\\x00-\\x7f\u00c0-\u00de\u00e0-\u00ff\u0400-\u045f\u3001\u3002\u3041-\u3096\u30a1-\u30fa\u30fc\u4e00-\u9fff"


def near(text: Column, terms: list[str], before: int, after: int) -> Column:
    """begin, text: the part of a text that its first match and its excerpt depend on, cut out in the JVM, so that Python
    gets windows and not texts. Up to the end of the first match by lower case all must be plain, and the terms too: then
    no other form matches before it. Any other text stays whole."""
    own = F.coalesce(text, F.lit(""))
    whole = F.struct(F.lit(0).alias("begin"), own.alias("text"))
    if re.search(f"[^{PLAIN}]", "".join(terms)):
        return whole
    # no lambdas: Spark loses sight of a Python function whose arguments have some
    places = [F.nullif(F.position(F.lit(t.lower()), F.lower(own)), F.lit(0)) for t in terms] or [F.lit(None).cast("int")]
    place = F.least(*places, *places[:1]) - 1
    longest = max(map(len, terms), default=0)
    head = F.substring(own, F.lit(1), F.coalesce(place + longest, F.length(own)))
    # a sharp s is "ss" in the compared form, so only terms with an s can match it
    odd = f"[^{PLAIN}]" if "s" in "".join(terms).lower() else f"[^{PLAIN}\u00df]"
    # one character more on each side shows that the text goes on; a term that begins in the window has its end
    begin = F.greatest(F.coalesce(place - before - 1, F.lit(0)), F.lit(0))
    end = F.coalesce(place + after + longest, F.lit(before + after)) + 1
    window = F.struct(begin.alias("begin"), F.substring(own, begin + 1, end - begin).alias("text"))
    return F.when(F.rlike(head, F.lit(odd)), whole).otherwise(window)


def _rows(parts: pa.Array, terms: pa.Array) -> Iterator[tuple[int, str, list[str]]]:
    """begin, text and terms one after the other, without a second copy of the batch."""
    return ((b.as_py(), x.as_py(), t.as_py() or []) for b, x, t in zip(parts.field("begin"), parts.field("text"), terms, strict=True))


@F.arrow_udf(StringType())
def _excerpts(parts: pa.Array, terms: pa.Array) -> pa.Array:
    return pa.array([excerpt(x, t) for _, x, t in _rows(parts, terms)], pa.string())


@F.arrow_udf(IntegerType())
def _first_matches(parts: pa.Array, terms: pa.Array) -> pa.Array:
    return pa.array([None if (at := first_match(x, t)) is None else b + at for b, x, t in _rows(parts, terms)], pa.int32())


def _on_windows(f, texts: Column | str, terms: Column | list[str], before: int, after: int) -> Column:
    own = F.col(texts) if isinstance(texts, str) else texts
    if isinstance(terms, Column):
        return f(F.struct(F.lit(0).alias("begin"), own.alias("text")), terms)
    terms = [t for t in terms if t]
    return f(near(own, terms, before, after), F.array(*map(F.lit, terms)).cast("array<string>"))


def excerpt_column(texts: Column | str, terms: Column | list[str]) -> Column:
    """excerpt of each row; for terms in a list Python gets windows, for terms in a column whole texts."""
    return _on_windows(_excerpts, texts, terms, BEFORE, AFTER)


def first_match_column(texts: Column | str, terms: Column | list[str]) -> Column:
    """first_match of each row, as in excerpt_column."""
    return _on_windows(_first_matches, texts, terms, 0, 0)


@F.pandas_udf(StringType())
def clause_at_column(texts: pd.Series, offsets: pd.Series, headings: pd.Series) -> pd.Series:
    whole = [None if o is None or o != o else int(o) for o in offsets]
    return pd.Series([clause_at(x, o, h) for x, o, h in zip(texts, whole, headings, strict=True)], dtype=object)


@F.pandas_udf(DoubleType())
def similarity_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(ArrayType(StructType([StructField("op", StringType()), StructField("text", StringType())])))
def line_diff_column(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([[{"op": o, "text": x} for o, x in line_diff(a or "", b or "")] for a, b in zip(old, new, strict=True)])
