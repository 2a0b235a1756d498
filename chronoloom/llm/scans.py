"""Noise in text from scanned pages: running headers, page numbers, broken words and misread characters."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.names import distance
from chronoloom.session import settle

#: What is printed and what a scanner reads (read, printed).
CONFUSIONS = (
    ("c", "e"), ("e", "c"), ("1", "i"), ("1", "l"), ("l", "i"), ("i", "l"), ("0", "o"), ("5", "s"), ("9", "g"), ("8", "b"), ("7", "t"), ("6", "b"), ("2", "z"), ("b", "h"), ("h", "b"), ("ı", "i"), ("á", "a"), ("à", "a"),
    ("i", "1"), ("l", "1"), ("o", "0"), ("s", "5"), ("é", "e"), ("í", "i"), ("ó", "o"), ("ri", "n"), ("rn", "m"), ("m", "rn"), ("ii", "u"), ("cl", "d"), ("d", "cl"), ("h", "li"), ("li", "h"), ("vv", "w"), ("w", "vv"), ("nn", "m"), ("in", "m"), ("ti", "h"), ("u", "ii"),
    ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("€", "c"), ("$", "s"), ("@", "a"), ("!", "l"), ("|", "l"), ("q", "g"), ("g", "q"), ("t", "f"), ("f", "t"),
)
#: Characters that break a word at the end of a line, and those that dirt leaves within words.
HYPHENS = "-‐‑¬­"
STRAY = "'|^~`´’‘¨°·•*_¦\\"
STRIP = ".,;:!?()[]{}\"“”«»"
#: A word gives way to another that is this many times as frequent, if confusions explain it.
RATIO = 20
#: A line is a running header if it is at the edge of two pages of its paper, or of pages of this many papers.
PAPERS = 5
#: Lines of scanned papers: the longest has so many letters, this share of lines is nearly full, a page has so many.
NARROW, WIDE, FULL, LINES = 30, 120, 0.45, 6
#: Words of more letters are no words of a language, and are not repaired.
LONGEST = 60
#: Cost of a confusion and of a stray character; other edits cost 1.5; repairs may cost MOST.
CONFUSION, MARK, OTHER, MOST = 0.35, 0.3, 1.5, 1.1
_BY_READ: dict[str, list[str]] = {}
for _r, _p in CONFUSIONS:
    _BY_READ.setdefault(_r, []).append(_p)
_DIGITS = str.maketrans({"l": "1", "I": "1", "i": "1", "|": "1", "O": "0", "o": "0", "S": "5", "s": "5", "B": "8", "Z": "2", "g": "9", "á": "4"})
_NUMBER = re.compile(r"^[\W_]*(?:(?:p|pp|pg|page|seite|s)\b\.?)?[\W_]*([0-9lIi|OoSsBZg]{1,6})(?:\s*(?:/|of|von)\s*[0-9lIi|OoSsBZg]{1,6})?[\W_]*$", re.I)
_DIGITLIKE = re.compile(r"[\W_]*(?=.*\d)[0-9lIOoSsá|]+[\W_]*")
_ROMAN = re.compile(r"^[\W_]*([ivxlcı1]{1,8})[\W_]*$", re.I)


def skeleton(text: str) -> str:
    """Letters with everything that scanners confuse made equal, without digits, marks and blanks."""
    t = unicodedata.normalize("NFKD", text.lower().replace("ı", "i"))
    t = "".join(c for c in t if c.isalnum() and c.isascii())
    for a, b in (("rn", "m"), ("ri", "n"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("li", "h"), ("1", "i"), ("l", "i"), ("0", "o"), ("5", "s"), ("9", "g"), ("8", "b"), ("7", "t"), ("c", "e"), ("b", "h"), ("ih", "u"), ("nn", "m"), ("in", "m")):
        t = t.replace(a, b)
    return re.sub(r"\d", "", t)


def without_number(line: str) -> str:
    """A line without a page number at either end."""
    t = re.sub(r"^\s*[0-9lIOoSsivxc|]{1,6}(?:\s{2,}|\s*[|·•–—-]\s+)", "", line)
    return re.sub(r"(?:\s{2,}|\s+[|·•–—-]\s*)[0-9lIOoSsivxc|]{1,6}\s*$", "", t)


def edge_key(line: str) -> str:
    """The skeleton of a line without its numbers: running headers of one journal differ in volume and year."""
    return skeleton(" ".join(w for w in without_number(line).split() if not _DIGITLIKE.fullmatch(w)))


def page_value(line: str) -> int | None:
    """The number on a line that holds nothing else but its dress; roman numbers count."""
    t = line.strip()
    if m := _NUMBER.match(t):
        digits = m[1].translate(_DIGITS)
        if digits.isdigit() and any(c.isdigit() for c in m[1]) or (digits.isdigit() and set(m[1]) <= set("lIO|")):
            return int(digits)
    if m := _ROMAN.match(t):
        value, last = 0, 0
        for c in reversed(m[1].lower().replace("ı", "i").replace("1", "i")):
            n = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c]
            value += n if n >= last else -n
            last = max(last, n)
        return value
    return None


def _zones(lines: list[str]) -> list[tuple[int, str]]:
    """Line numbers (from 0) of the two first and two last lines that aren't blank, with where they are."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    found = [(i, "t") for i in full[:2]] + [(i, "b") for i in full[-2:] if i not in full[:2]]
    return found


def _first_look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each page: the skeletons of its edge lines, values that may be page numbers, and the head of the page."""
    for frame in frames:
        out = []
        for id_, paper, page, text in zip(frame["id"], frame["paper"], frame["page"], frame["text"]):
            lines = text.split("\n")
            edge = _zones(lines)
            keys = [edge_key(lines[i]) for i, _ in edge]
            values = [v - int(page) for i, _ in edge if (v := page_value(lines[i])) is not None and not pd.isna(page)]
            head = [x for x in (y.strip() for y in lines) if x and page_value(x) is None][:2]
            out.append((id_, paper, page, text, [k for k in keys if len(k) > 5], values, skeleton(head[0]) if head else "", skeleton(re.split(r",| and | & ", head[1])[0]) if len(head) > 1 else ""))
        yield pd.DataFrame(out, columns=["id", "paper", "page", "text", "edge", "offsets", "title", "author"])


def _classify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each page's headers and page numbers, and its body lines."""
    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            lines = r.text.split("\n")
            first = bool(r.first)
            known = set(r.headers) if r.headers is not None else set()
            offset = None if pd.isna(r.offset) else int(r.offset)
            header, number = set(), set()
            full = [i for i, x in enumerate(lines) if x.strip()]
            title_at = next((i for i in full if page_value(lines[i]) is None), None) if first else None

            def is_header(i: int) -> bool:
                line = lines[i].strip()
                s = skeleton(without_number(line))
                if i == title_at or not s:
                    return False
                e = edge_key(line)
                if len(e) > 5 and (e in known or any(len(k) > 11 and abs(len(k) - len(e)) <= 2 and distance(k, e) <= 3 for k in known)):
                    return True
                if first or len(line) > 110:
                    return False
                long = len(s) >= 12 and (r.title.startswith(s) or (len(r.title) >= 12 and s.startswith(r.title)))
                return long or (s.endswith(skeleton("et al")) and line[:1].isalnum() and len(line) < 60 and not line.rstrip().endswith(",") and len(line.split()) <= 8)

            def is_number(i: int) -> bool:
                v = page_value(lines[i])
                if v is None or pd.isna(r.page):
                    return False
                return offset is None or v - int(r.page) == offset

            for order in (full[:3], full[::-1][:3]):
                for i in order:
                    if i in header or i in number:
                        continue
                    if is_number(i):
                        number.add(i)
                    elif is_header(i):
                        header.add(i)
                    else:
                        break
            skip = set()
            if first and title_at is not None:  # title and authors: all up to the first blank line
                for i in range(title_at, len(lines)):
                    if not lines[i].strip():
                        break
                    skip.add(i)
                if len(skip) > 6:
                    skip = {i for i in sorted(skip)[:2]}
                header -= {title_at}
            body = [(i + 1, lines[i].rstrip("\r")) for i in full if i not in header and i not in number and i not in skip]
            blank = [i + 1 for i, x in enumerate(lines) if not x.strip()]
            out.append((r.id, r.paper, r.page, sorted(i + 1 for i in header), sorted(i + 1 for i in number), [{"line": a, "text": b} for a, b in body], blank))
        yield pd.DataFrame(out, columns=["id", "paper", "page", "header", "number", "body", "blank"])


def core_of(token: str) -> str:
    return token.strip(STRIP)


@lru_cache(maxsize=500_000)
def look(raw: str) -> tuple[str, str]:
    """The word of a token, and in which way it is no print: ligature, stray or number ('' if in none)."""
    core = core_of(raw)
    if any("ﬀ" <= c <= "ﬆ" for c in raw):
        return core.lower(), "ligature"
    if not any(c.isalnum() for c in raw) and any(c in STRAY for c in raw):
        return core.lower(), "stray"
    if _MIXED.fullmatch(core) and not _COUNTED.fullmatch(core):
        return core.lower(), "number"
    return core.lower(), ""


#: Digits with letters that look like digits between them, and what is written so on purpose (1990s).
_MIXED = re.compile(r"(?=.*\d)(?=.*[lIOoSs])[0-9lIOoSs.,]+")
_COUNTED = re.compile(r"\d+s")


def printed_as(word: str, shape: str) -> str:
    """What was printed where a word is none: ligatures as letters, digits in a number, no stray marks."""
    if shape == "ligature":
        return unicodedata.normalize("NFKC", word)
    return "" if shape == "stray" else word.translate(_DIGITS)


def _tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of body lines; of a word that may be broken at a line's end both readings (joined and hyphenated)."""
    columns = ["id", "line", "pos", "raw", "word", "prev", "joined", "hyphenated", "id2", "line2", "raw2", "head", "shape"]
    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            body = [(x["line"], x["text"].split()) for x in r.body]
            body = [b for b in body if b[1]]
            prev, taken = "", False
            for n, (line, words) in enumerate(body):
                for pos, raw in enumerate(words):
                    if pos == 0 and taken:
                        taken = False
                        prev = core_of(raw).lower()
                        continue
                    word, shape = look(raw)
                    last = pos == len(words) - 1
                    if last and len(raw) > 1 and raw[-1] in HYPHENS and any(c.isalpha() for c in raw):
                        follow = (r.id, body[n + 1][0], body[n + 1][1][0]) if n + 1 < len(body) else (r.next_id, r.next_line, r.next_word)
                        if follow[0] is not None and follow[2] and follow[2][0].isalpha() | (follow[2][0] in STRAY) | follow[2][0].isdigit():
                            head = raw[:-1].lstrip(STRIP).lower()
                            rest = core_of(follow[2]).lower()
                            out.append((r.id, line, pos, raw, head + rest, prev, head + rest, f"{head}-{rest}", follow[0], int(follow[1]), follow[2], head, ""))
                            taken = n + 1 < len(body)
                            prev = rest
                            continue
                    out.append((r.id, line, pos, raw, word, prev, None, None, None, -1, None, None, shape))
                    prev = word
            # the next page's first word may end a word of this page; it is then known as a rest by its place
        yield pd.DataFrame(out, columns=columns)


def _deletes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Symmetric-delete forms of words: up to two letters dropped (one of words under five letters)."""
    for frame in frames:
        words, forms = [], []
        for w in frame["w"]:
            one = {w[:i] + w[i + 1 :] for i in range(len(w))}
            all_ = {w} | one
            if len(w) >= 5:
                all_ |= {x[:i] + x[i + 1 :] for x in one for i in range(len(x))}
            words += [w] * len(all_)
            forms += all_
        yield pd.DataFrame({"w": words, "form": forms})


def repair_cost(read: str, printed: str) -> float:
    """Weighted edits from the printed word to what was read; confusion pairs and stray marks are cheap."""
    n, m = len(read), len(printed)
    row = [[math.inf] * (m + 1) for _ in range(n + 1)]
    row[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            c = row[i][j]
            if c > MOST:
                continue
            if i < n and j < m and read[i] == printed[j]:
                row[i + 1][j + 1] = min(row[i + 1][j + 1], c)
            if i < n:
                row[i + 1][j] = min(row[i + 1][j], c + (MARK if read[i] in STRAY else OTHER))
            if i < n and j < m:
                row[i + 1][j + 1] = min(row[i + 1][j + 1], c + OTHER)
            if j < m:
                row[i][j + 1] = min(row[i][j + 1], c + OTHER)
            for width in (1, 2):
                for p in _BY_READ.get(read[i : i + width], ()) if i + width <= n else ():
                    if printed.startswith(p, j):
                        row[i + width][j + len(p)] = min(row[i + width][j + len(p)], c + CONFUSION)
    return row[n][m]


def _costs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield frame.assign(cost=[repair_cost(a, b) for a, b in zip(frame["w"], frame["c"])])


def one_per_id(chunks: DataFrame) -> DataFrame:
    """id, paper, page, text: of repeated rows the one with the longest text."""
    row = F.struct(F.col("paper_id").alias("paper"), "page", "text")
    return chunks.where("text IS NOT NULL AND id IS NOT NULL").groupBy("id").agg(F.max_by(row, F.struct(F.length("text"), "text")).alias("r")).select("id", "r.*")


def scanned_pages(chunks: DataFrame, narrow: int = NARROW, wide: int = WIDE) -> DataFrame:
    """id, paper, page, text of the pages of scanned papers: the longest line has ``narrow`` to ``wide`` letters, most lines are full."""
    once = one_per_id(chunks)
    sizes = F.filter(F.transform(F.split("text", "\n"), lambda x: F.length(F.trim(F.regexp_replace(x, "\r", "")))), lambda n: n > 0)
    pages = once.withColumn("n", sizes)
    stats = pages.groupBy("paper").agg(
        F.max(F.array_max("n")).alias("most"), F.sum(F.size("n")).alias("lines"), F.count(F.lit(1)).alias("pages"),
        F.sum(F.size(F.filter("n", lambda x: x >= 0.7 * F.array_max("n")))).alias("full"),
    ).where((F.col("most").between(narrow, wide)) & (F.col("full") >= FULL * F.col("lines")) & (F.col("lines") >= LINES * F.col("pages")))
    return once.join(stats.select("paper"), "paper", "left_semi").select("id", "paper", "page", "text")


def read_pages(chunks: DataFrame, narrow: int = NARROW, wide: int = WIDE) -> DataFrame:
    """Pages of scanned papers with their headers, page numbers and body lines: id, paper, page, header, number, body, blank."""
    seen = settle(scanned_pages(chunks, narrow, wide).mapInPandas(_first_look, "id string, paper string, page int, text string, edge array<string>, offsets array<int>, title string, author string"))
    edges = settle(seen.select("paper", F.explode(F.array_distinct("edge")).alias("k")).groupBy("paper", "k").agg(F.count(F.lit(1)).alias("c")))
    common = edges.groupBy("k").agg(F.count(F.lit(1)).alias("papers")).where(F.col("papers") >= PAPERS)
    often = edges.join(common, "k", "left").where("c > 1 OR papers IS NOT NULL")
    often = often.groupBy("paper").agg(F.collect_list("k").alias("headers"))
    votes = seen.select("paper", F.explode(F.array_distinct("offsets")).alias("o")).groupBy("paper", "o").agg(F.count(F.lit(1)).alias("c"))
    votes = votes.groupBy("paper").agg(F.max_by("o", F.struct("c", -F.abs("o"))).alias("offset"))
    heads = seen.groupBy("paper").agg(F.min_by(F.struct("page", "title", "author"), F.struct("page", "id")).alias("h"))
    pages = seen.select("id", "paper", "page", "text").join(often, "paper", "left").join(votes, "paper", "left").join(heads, "paper")
    pages = pages.select("id", "paper", "page", "text", "headers", "offset", "h.title", "h.author", F.col("page").eqNullSafe(F.col("h.page")).alias("first"))
    return settle(pages.mapInPandas(_classify, "id string, paper string, page int, header array<int>, number array<int>, body array<struct<line:int,text:string>>, blank array<int>"))


def page_words(pages: DataFrame) -> DataFrame:
    """Words of the body with what may be their rest on the next line or page."""
    order = Window.partitionBy("paper").orderBy("page", "id")
    first = F.try_element_at("body", F.lit(1))
    lead = lambda c: F.lead(c, 1).over(order)
    head = pages.where(F.size("body") > 0).withColumn("fw", F.try_element_at(F.split(F.trim(F.regexp_replace(first["text"], r"\s+", " ")), " "), F.lit(1))).withColumn("fl", first["line"])
    head = head.select("id", "body", lead("id").alias("next_id"), lead("fl").alias("next_line"), lead("fw").alias("next_word"))
    schema = "id string, line int, pos int, raw string, word string, prev string, joined string, hyphenated string, id2 string, line2 int, raw2 string, head string, shape string"
    return settle(head.mapInPandas(_tokens, schema))


def lexicon(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Word counts and counts of neighbouring words over all texts, of repeated rows the same one as everywhere.

    Neighbours are counted once, a text's last word with none; a word's count is the sum over what follows it.
    """
    clean = F.transform(F.split(F.lower("text"), r"[\s\u00a0]+"), lambda x: F.btrim(x, F.lit(STRIP)))
    words = one_per_id(chunks).select(F.filter(clean, lambda x: x != "").alias("ws"))
    two = words.select(F.explode(F.arrays_zip(F.col("ws").alias("a"), F.expr("slice(ws, 2, greatest(size(ws), 1))").alias("b"))).alias("z")).select("z.a", "z.b").where("a IS NOT NULL")
    pairs = settle(two.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
    return settle(pairs.groupBy(F.col("a").alias("w")).agg(F.sum("n").alias("n"))), pairs.where("b IS NOT NULL")


def _printed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield frame.assign(c=[printed_as(w, k) for w, k in zip(frame["w"], frame["shape"])]).drop(columns=["shape"])


def repairs(words: DataFrame, counts: DataFrame, pairs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """prev, w, c, cost: the printed word c for a misread w after prev.

    Candidates come from the symmetric-delete index of words that are RATIO times as frequent, and, for what is
    no print (ligatures, stray marks, digits mixed with letters), from writing it plainly; of those that
    confusions explain, the one with the best frequency, context (bigrams) and cost is taken.  Words of
    ``longest`` letters or more aren't looked up in the index.
    """
    asked = words.select("word").union(words.where("joined IS NOT NULL").select("hyphenated")).distinct().select(F.col("word").alias("w")).where((F.length("w") > 2) & (F.length("w") < longest) & F.col("w").rlike("[^0-9.,%/-]"))
    asked = asked.join(counts, "w", "left").select("w", F.coalesce("n", F.lit(1)).alias("n"))
    index = counts.where((F.col("n") >= RATIO) & F.col("w").rlike(r"^[a-z][a-z.-]*$") & (F.length("w") > 1)).select(F.col("w"), F.col("n"))
    forms = asked.select("w").mapInPandas(_deletes, "w string, form string").select("w", F.xxhash64("form").alias("form"))
    known = index.select("w").mapInPandas(_deletes, "w string, form string").select(F.col("w").alias("c"), F.xxhash64("form").alias("form"))
    near = forms.join(known, "form").where("w != c AND abs(length(w) - length(c)) <= 3").select("w", "c").distinct()
    near = near.join(asked, "w").join(index.select(F.col("w").alias("c"), F.col("n").alias("cn")), "c").where(F.col("cn") >= RATIO * F.col("n"))
    odd = words.where("shape != '' AND joined IS NULL").groupBy(F.col("word").alias("w")).agg(F.max("shape").alias("shape")).join(counts, "w", "left").select("w", "shape", F.coalesce("n", F.lit(1)).alias("n"))
    odd = odd.mapInPandas(_printed, "w string, n bigint, c string").where("c != w").join(counts.select(F.col("w").alias("c"), F.col("n").alias("cn")), "c", "left")
    near = near.select("w", "c", "n", "cn").union(odd.select("w", "c", "n", F.coalesce("cn", F.lit(1))))
    near = settle(near.distinct().mapInPandas(_costs, "w string, c string, n bigint, cn bigint, cost double").where(F.col("cost") <= MOST))
    places = words.select("prev", F.col("word").alias("w")).union(words.where("joined IS NOT NULL").select("prev", "hyphenated")).join(near.select("w"), "w", "left_semi").distinct()
    tried = places.join(near, "w").join(pairs.select(F.col("a").alias("prev"), F.col("b").alias("c"), F.col("n").alias("together")), ["prev", "c"], "left")
    score = F.log("cn") + F.log(F.coalesce("together", F.lit(0)) + 0.5) - 4 * F.col("cost")
    best = Window.partitionBy("prev", "w").orderBy(F.desc(score), "c")
    return settle(tried.withColumn("r", F.row_number().over(best)).where("r = 1").select("prev", "w", "c", "cost", "cn"))


def judged_words(words: DataFrame, counts: DataFrame, mends: DataFrame) -> DataFrame:
    """Words with their repair: broken (a word cut by a hyphen), fixed (the printed word), bad (misread), where (1 or 2: which line)."""
    n = counts.select(F.col("w").alias("k"), "n")
    plain = words.where("joined IS NULL").join(mends.select("prev", F.col("w").alias("word"), "c"), ["prev", "word"], "left")
    plain = plain.select("id", "line", "pos", "raw", "word", F.coalesce("c", "word").alias("fixed"), F.lit(False).alias("broken"), F.col("c").isNotNull().alias("bad"), F.lit("").alias("second"), F.lit(None).cast("string").alias("id2"), F.lit(-1).alias("line2"), F.lit(None).cast("string").alias("raw2"))
    m = lambda x: mends.select("prev", F.col("w").alias(x), F.col("c").alias(f"c_{x}"), F.col("cn").alias(f"n_{x}"))
    cut = words.where("joined IS NOT NULL").join(m("joined"), ["prev", "joined"], "left").join(m("hyphenated"), ["prev", "hyphenated"], "left")
    cut = cut.join(n.select(F.col("k").alias("joined"), F.col("n").alias("own_j")), "joined", "left").join(n.select(F.col("k").alias("hyphenated"), F.col("n").alias("own_h")), "hyphenated", "left")
    nj, nh = F.coalesce("n_joined", "own_j", F.lit(0)), F.coalesce("n_hyphenated", "own_h", F.lit(0))
    broken = nj >= nh
    fixed = F.when(broken, F.coalesce("c_joined", "joined")).otherwise(F.coalesce("c_hyphenated", "hyphenated"))
    read = F.when(broken, F.col("joined")).otherwise(F.col("hyphenated"))
    odd = "array_contains(transform(sequence(1, length({0})), i -> substr({0}, i, 1) BETWEEN 'ﬀ' AND 'ﬆ'), true)"
    wrong = fixed != read
    head_ok = fixed.startswith(F.col("head"))
    cut = cut.select("id", "line", "pos", "raw", read.alias("word"), fixed.alias("fixed"), broken.alias("broken"), ((wrong & ~head_ok) | F.expr(odd.format("raw"))).alias("bad"), F.when((wrong & head_ok) | F.expr(odd.format("raw2")) | (wrong & ~_tail_ok()), "x").otherwise("").alias("second"), "id2", "line2", "raw2")
    return plain.unionByName(cut)


def _tail_ok():
    """Whether the printed word ends with what stands on the next line."""
    rest = F.expr("substr(joined, length(head) + 1)")
    fixed = F.coalesce("c_joined", "c_hyphenated", "joined")
    return fixed.endswith(rest)


def faulty_lines(chunks: DataFrame, narrow: int = NARROW, wide: int = WIDE, longest: int = LONGEST) -> DataFrame:
    """chunk_id, kind ('header' | 'page_no' | 'hyphen' | 'chars'), line_no of every faulty line of scanned pages.

    ``chunks``: id, text, page, paper_id.  Texts that are null or blank, and papers that weren't scanned
    (lines outside ``narrow`` to ``wide`` letters), give nothing; of repeated rows the longest counts; a null page
    is taken as the first.  Words of ``longest`` letters or more are taken as they stand.

    A line at a page's edge is a header if other pages of the paper, or pages of PAPERS papers, have it there,
    but for what scanners confuse and up to three letters.

    Plan: pages are read in Arrow batches; what repeats at the edges of pages is counted per paper by hash;
    the only windows are over one small row per page.  Words are counted once over the whole corpus, and
    all candidate search, cost and context work is on distinct words; a deletion form is shared by at most as
    many words as two letters can be put into it, however many rows there are.
    """
    pages = read_pages(chunks, narrow, wide)
    words = page_words(pages)
    counts, pairs = lexicon(chunks)
    judged = settle(judged_words(words, counts, repairs(words, counts, pairs, longest)))
    kind = lambda df, k, line: df.select(F.col("id").alias("chunk_id"), F.lit(k).alias("kind"), F.col(line).alias("line_no"))
    parts = kind(pages.select("id", F.explode("header").alias("l")), "header", "l").unionByName(kind(pages.select("id", F.explode("number").alias("l")), "page_no", "l"))
    parts = parts.unionByName(kind(judged.where("broken"), "hyphen", "line")).unionByName(kind(judged.where("bad"), "chars", "line"))
    other = judged.where("second = 'x'").select(F.col("id2").alias("id"), F.col("line2").alias("line"))
    return parts.unionByName(kind(other, "chars", "line")).distinct()


def paragraphs(chunks: DataFrame) -> DataFrame:
    """paper_id, paragraph (from 1), text: the body of each scanned paper, repaired, in the order of its pages.

    A paragraph begins after a blank line between body lines, at an indented line, and at a new page only
    if one of these holds there or the page before ended a sentence before a short line.
    """
    pages = read_pages(chunks)
    words = page_words(pages)
    counts, pairs = lexicon(chunks)
    judged = settle(judged_words(words, counts, repairs(words, counts, pairs)))
    lines = pages.select("id", "paper", "page", "blank", F.explode("body").alias("x")).select("id", "paper", "page", F.col("x.line").alias("line"), F.col("x.text").alias("text"), (F.array_contains("blank", F.col("x.line") - 1) & (F.col("x.line") > 1)).alias("after_blank"))
    def dressed(raw, fixed):  # noqa: ANN001, ANN202
        """The repaired word in the dress (case, marks) of what was read."""
        core = F.regexp_extract(raw, r"^[.,;:!?()\[\]{}\"“”«»]*(.*?)[.,;:!?()\[\]{}\"“”«»]*$", 1)
        upper = F.substring(core, 1, 1) != F.lower(F.substring(core, 1, 1))
        word = F.when(upper, F.concat(F.upper(F.substring(fixed, 1, 1)), F.expr("substr(fixed, 2)"))).otherwise(fixed)
        lead = F.regexp_extract(raw, r"^([.,;:!?()\[\]{}\"“”«»]*)", 1)
        tail = F.regexp_extract(raw, r"[^.,;:!?()\[\]{}\"“”«»]([.,;:!?()\[\]{}\"“”«»]*)$", 1)
        return F.concat(lead, word, tail)

    same = F.col("fixed") == F.col("word")
    shown = judged.withColumn("shown", F.when(F.col("raw2").isNull(), F.when(same, F.col("raw")).otherwise(dressed(F.col("raw"), F.col("fixed")))).otherwise(F.concat(F.regexp_extract("raw", r"^([.,;:!?()\[\]{}\"“”«»]*)", 1), F.col("fixed"), F.regexp_extract("raw2", r"[^.,;:!?()\[\]{}\"“”«»]([.,;:!?()\[\]{}\"“”«»]*)$", 1))))
    text = shown.groupBy("id", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "shown"))), lambda z: z["shown"]), " ").alias("shown"))
    moved = judged.where("raw2 IS NOT NULL AND id != id2").select(F.col("id2").alias("id"), F.col("line2").alias("line"), F.lit(True).alias("gone"), F.col("raw2"))
    lines = lines.join(text, ["id", "line"], "left").join(moved, ["id", "line"], "left")
    lines = lines.withColumn("shown", F.when(F.col("gone") & F.expr("shown LIKE concat(raw2, '%')"), F.expr("substr(shown, length(raw2) + 2)")).otherwise(F.coalesce("shown", F.lit(""))))
    order = Window.partitionBy("paper").orderBy("page", "id", "line")
    new_page = F.lag("id").over(order) != F.col("id")
    starts = F.coalesce((F.col("after_blank") & ~new_page) | F.col("text").rlike(r"^\s{2,}\S") | (new_page & F.lag("text").over(order).rlike(r"[.!?]\s*$") & (F.length(F.lag("text").over(order)) < 0.7 * F.length("text"))), F.lit(True))
    numbered = lines.withColumn("paragraph", F.sum(F.when(starts, 1).otherwise(0)).over(order))
    joined = numbered.where("shown != ''").groupBy("paper", "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "id", "line", "shown"))), lambda z: z["shown"]), " ").alias("text"))
    return joined.select(F.col("paper").alias("paper_id"), F.col("paragraph").cast("int"), "text")
