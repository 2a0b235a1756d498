"""Text, hash, date and reference functions as columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that keyword search leaves out.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can to of in for on with at by from as into about like "
    "through after over between out up and but or not no so if than too very just it its this that these those he she they we you i me my your his her their our"
).split()
#: Words that notes leave out of their keywords.
NOTE_STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can need dare ought used to of in for on with at by from as into "
    "through during before after above below between but and or not no nor so yet both either neither each every all any few more most other some such than too very just about "
    "also that this these those what which who whom how when where why it its he she they them his her their"
).split()
#: Date formats, tried in this order after RFC 3339.
DATE_FORMATS = ("yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "yyyy/MM/dd", "MM/dd/yyyy", "MMMM yyyy", "MMM yyyy")


def array_of(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def words_of(text: Column) -> Column:
    """Runs of characters without white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def normalize_name(name: Column) -> Column:
    """Lower case, '_' and '-' as blanks, single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(name), "_-", "  "), r"\s+", " "))


def extract_terms(text: Column) -> Column:
    """Lower-case words of more than two bytes, trimmed of what isn't a letter or number; no empty ones."""
    long = F.filter(words_of(F.lower(text)), lambda w: F.octet_length(w) > 2)
    return F.filter(F.transform(long, lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda w: w != "")


def estimate_tokens(text: Column) -> Column:
    """Four bytes a token, rounded up."""
    return F.ceil(F.octet_length(text) / 4)


def truncate_to_tokens(text: Column, tokens: int) -> Column:
    """The text if it fits into tokens of four bytes, else its whole characters within that, up to the last blank, and '...'."""
    size = tokens * 4
    head = F.substring(text, 1, size)
    # fewer characters where some take more than a byte; none takes more than four
    fits = F.array_max(F.filter(F.sequence(F.lit(tokens), F.lit(size)), lambda n: F.octet_length(F.substr(text, F.lit(1), n)) <= size))
    head = F.when(F.octet_length(head) <= size, head).otherwise(F.substr(text, F.lit(1), fits))
    cut = F.when(head.contains(" "), F.regexp_extract(head, r"^(?s)(.*) ", 1)).otherwise(head)
    return F.when(F.octet_length(text) <= size, text).otherwise(F.concat(cut, F.lit("...")))


def normalize_for_hash(text: Column) -> Column:
    return F.array_join(words_of(F.lower(text)), " ")


def content_hash(text: Column) -> Column:
    return F.sha2(normalize_for_hash(text), 256)


def entity_key(name: Column, kind: Column) -> Column:
    return F.sha2(normalize_for_hash(F.concat_ws("::", F.lower(F.trim(name)), F.lower(F.trim(kind)))), 256)


def relationship_key(source: Column, target: Column, kind: Column) -> Column:
    return F.sha2(normalize_for_hash(F.concat_ws("::", F.lower(F.trim(source)), F.lower(F.trim(kind)), F.lower(F.trim(target)))), 256)


def cache_key(prompt: Column, model: Column) -> Column:
    return F.sha2(F.concat(prompt, F.lit("|"), model), 256)


def bm25_tokens(text: Column) -> Column:
    """Lower case, cut at all but letters, numbers and apostrophes, over one byte, without stop words."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}']+"), lambda w: (F.octet_length(w) > 1) & ~w.isin(STOP_WORDS))


def note_keywords(text: Column) -> Column:
    """Distinct words of over three bytes in order of first sight, without stop words, at most 20."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: (F.octet_length(w) > 3) & ~w.isin(NOTE_STOP_WORDS))
    return F.slice(F.array_distinct(words), 1, 20)


def normalize_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 1 if both are empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def text_match(text: Column, query: Column) -> Column:
    """Share of the query's words of over one byte that the text contains."""
    words = F.filter(words_of(F.lower(query)), lambda w: F.octet_length(w) > 1)
    low = F.lower(text)
    return F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.filter(words, lambda w: low.contains(w))) / F.size(words))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def parse_date(text: Column) -> Column:
    """RFC 3339, year-month-day, a bare year, then the other formats; month and year give the first day."""
    t = F.trim(text)
    tried = [F.when(t.rlike(r"^\d{4}-\d\d-\d\d[T ]"), F.try_to_timestamp(t)), F.when(t.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_timestamp(t, F.lit("yyyy-MM-dd"))), F.when(t.rlike(r"^\d{4}$"), F.try_to_timestamp(F.concat(t, F.lit("-01-01")), F.lit("yyyy-MM-dd")))]
    return F.coalesce(*tried, *[F.try_to_timestamp(t, F.lit(f)) for f in DATE_FORMATS[1:]])


def extract_year(text: Column) -> Column:
    """The first four digits that are a year from 1900 to 2030."""
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(\d{4})"), 1), lambda y: y.cast("int")), lambda y: y.between(1900, 2030))
    return F.try_element_at(found, F.lit(1))


def extract_doi(text: Column) -> Column:
    found = F.regexp_replace(F.regexp_extract(text, r"(10\.[^\s,;)]*)", 1), r"\.+$", "")
    return F.when(found.contains("/"), found)


def extract_arxiv(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"arXiv:\s*([^\s,;\]]+)", 1), F.lit(""))


def reference_title(text: Column) -> Column:
    """The first quoted span of more than five bytes."""
    return F.nullif(F.regexp_extract(text, r'"([^"]{6,})"', 1), F.lit(""))


def reference_authors(text: Column) -> Column:
    """What stands before the first digit or quote, at commas and semicolons, at most ten."""
    head = F.regexp_extract(text, r'^([^\d"]*)', 1)
    return F.slice(F.filter(F.transform(F.split(head, r"[,;]"), lambda x: F.trim(F.regexp_replace(x, r"[().]+$", ""))), lambda x: F.length(x) > 1), 1, 10)


def looks_like_name(text: Column) -> Column:
    return (text != "") & (F.octet_length(text) < 100) & ~text.contains("\n") & text.rlike(r"^\p{Lu}")


#: What a JSON key says about the type of its value.
KEY_TYPES = (("Organization", "company organization org employer institution".split()), ("Location", "city country location address place".split()), ("Person", "name person author user manager ceo founder".split()))


def type_from_key(key: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for kind, words in KEY_TYPES:
        cond = F.lit(False)
        for w in words:
            cond = cond | F.lower(key).contains(w)
        out = out.when(cond, F.lit(kind))
    return out.otherwise(F.lit("Entity"))


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def count_contained(text: Column, words: list[str]) -> Column:
    out = F.lit(0)
    for w in words:
        out = out + F.when(text.contains(w), 1).otherwise(0)
    return out


#: Places, words beside a place, endings of organisations, months, and words beside a person.
PLACES = "new york|san francisco|sf|nyc|london|paris|tokyo|los angeles|la|chicago|boston|seattle|berlin|beijing|shanghai|mumbai|delhi|bangalore|usa|us|uk|india|china|japan|france|germany".split("|")
PLACE_WORDS = "city country state town village island mountain river lake ocean street avenue".split()
FIRM_ENDINGS = "Inc Corp LLC Ltd Co Company Foundation University Institute Association Group Labs".split()
FIRM_LEADS = ["works at", "joined", "founded", "left", "ceo of"]
MONTHS = "january february march april may june july august september october november december".split()
PERSON_WORDS = "works lives born married moved said joined founded ceo mr. mrs. dr. prof.".split()
#: Words of a question that name nothing.
QUESTION_STOP = (
    "what is the a an of in to for and or how does do are was were been be can could would should will did has have had about tell me explain describe show "
    "find search between from with by at on it this that these those all related connected links only just my"
).split()


def infer_entity_type(name: Column, context: Column) -> Column:
    """Location, Organization, Date, Person or Entity by the first rule that holds for a name in its context."""
    n, c = F.lower(name), F.lower(context)
    near = lambda *parts: c.contains(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    any_ = lambda conds: reduce(or_, conds)
    place = n.isin(PLACES) | any_([near(n, f" {w}") | near(n, f" is a {w}") for w in PLACE_WORDS]) | any_([near(f"{w} ", n) for w in ("in", "to", "from")])
    firm = any_([name.endswith(s) for s in FIRM_ENDINGS]) | any_([near(f"{w} ", n) for w in FIRM_LEADS])
    date = any_([n.contains(m) for m in MONTHS]) | name.rlike(r"^[0-9/-]*$")
    person = any_([near(n, f" {w}") | near(f"{w} ", n) for w in PERSON_WORDS])
    return F.when(place, "Location").when(firm, "Organization").when(date, "Date").when(person, "Person").otherwise("Entity")


def question_words(question: Column) -> Column:
    """Words of over two bytes, trimmed of what isn't a letter or number, that may name something."""
    bare = F.transform(words_of(question), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(bare, lambda w: (F.octet_length(w) > 2) & ~w.isin(QUESTION_STOP))
