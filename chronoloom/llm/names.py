"""Variant spellings of names: canonical rewritings, equi-joins on them, and their rarity."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.session import settle

#: Given names and their short forms.
NICKNAMES = {
    "alexander": "alex sasha al sandy xander", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny benji", "charles": "charlie chuck chas",
    "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davy", "dorothy": "dot dolly dottie dora", "edward": "ed eddie ned ted teddy",
    "elizabeth": "beth liz lizzie betty eliza bess libby", "frances": "fran fanny", "francesca": "fran cesca franca", "frederick": "fred freddy", "gabriele": "gabi gaby",
    "gregory": "greg", "henrietta": "etta hetty hettie", "henry": "harry hank", "james": "jim jimmy jamie", "jennifer": "jen jenny jenn", "john": "jack johnny",
    "joseph": "joe joey", "josephine": "jo josie", "katherine": "kate kathy katie kat kitty kath", "leonhard": "leo lenny len", "lawrence": "larry", "margaret": "maggie meg peggy marge madge greta",
    "matthew": "matt", "michael": "mike mick mickey micky", "nathaniel": "nat nate nathan", "nicholas": "nick nico", "patricia": "pat patty trish tricia", "peter": "pete",
    "philip": "phil", "rebecca": "becky", "richard": "dick rick ricky rich", "robert": "bob bobby rob robbie", "samuel": "sam sammy", "samantha": "sam", "stephen": "steve",
    "susanna": "sue susie sanna suzy", "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim", "victoria": "vicky vic tori vicki", "william": "will bill billy liam willy",
}
#: Titles before a person's name.
TITLES = frozenset("dr prof professor mr mrs ms miss sir dame rev phd md".split())
#: Legal and institutional forms, each with the word that stands for it.
FORMS = {
    "labs": "lab labs laboratory laboratories laboratorium", "corporation": "corp corporation", "foundation": "fdn foundation fundacion stiftung fondation",
    "university": "univ university universitat universidad universite", "institute": "inst institute institut instituto", "research": "res research recherche",
    "centre": "ctr centre center centro zentrum", "company": "co company", "academy": "academy acad", "college": "college coll", "society": "society soc", "group": "group grp",
}
#: Suffixes and small words that distinguish nobody.
NOISE = frozenset("the of for and de la le du des di da inc incorporated ltd limited llc gmbh plc sa ag".split())
#: Neighbours on the keyboard.
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
NO_NAMES = frozenset({"et al.", "et al", "anonymous", "unknown", "n/a", "others"})

_FORM = {w: k for k, v in FORMS.items() for w in v.split()}
_SHORT: dict[str, list[str]] = {}
for _full, _forms in NICKNAMES.items():
    for _w in _forms.split():
        _SHORT.setdefault(_w, []).append(_full)
_NEAR = {c: set() for c in "abcdefghijklmnopqrstuvwxyz"}
for _y, _row in enumerate(ROWS):
    for _x, _c in enumerate(_row):
        for _dy, _dx in ((0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)):
            if 0 <= _y + _dy < 3 and 0 <= _x + _dx < len(ROWS[_y + _dy]):
                _NEAR[_c].add(ROWS[_y + _dy][_x + _dx])
_SPELT = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "å": "aa", "ø": "oe", "æ": "ae", "ß": "ss", "œ": "oe"})
_PLAIN = str.maketrans({"ø": "o", "æ": "ae", "ß": "ss", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})
READING = "name string, kind string, a string, b string, swapped boolean, sure boolean, initial string, middle string, spelt_a string, spelt_b string"


def plain(word: str) -> str:
    """Lower case without marks."""
    word = unicodedata.normalize("NFKD", word.lower().translate(_PLAIN))
    return "".join(c for c in word if not unicodedata.combining(c))


def spelt(word: str) -> str:
    """Lower case with marks spelt out as two letters (ae, oe, ue, aa)."""
    return plain(unicodedata.normalize("NFC", word).lower().translate(_SPELT))


def read_person(name: str) -> dict | None:
    """A person's name taken apart: surname b, given name a or initial; swapped and sure say how the order was told."""
    text = " ".join(unicodedata.normalize("NFC", name).split())
    text = re.sub(r"\b([^\W\d_])\.(?=\S)", r"\1. ", text)
    comma = "," in text
    head, _, tail = text.partition(",")
    words = [w for w in (f"{tail} {head}" if comma else text).replace(",", " ").split() if plain(w.strip(".")) not in TITLES]
    cut = len([w for w in tail.replace(",", " ").split() if plain(w.strip(".")) not in TITLES]) if comma else None
    initials = [i for i, w in enumerate(words) if len(w.strip(".")) == 1 and w.strip(".").isalpha()]
    long = [i for i, w in enumerate(words) if i not in initials and any(c.isalpha() for c in w)]
    if not long:
        return None
    letter = lambda i: plain(words[i])[:1]
    if len(long) == 1 or (comma and all(i >= cut for i in long)):
        if not initials:
            return None
        last = " ".join(words[i] for i in long)
        return {"a": None, "b": plain(last), "swapped": False, "sure": True, "initial": letter(initials[0]), "middle": "".join(letter(i) for i in initials[1:]) or None, "spelt_a": None, "spelt_b": spelt(last)}
    sure = swapped = False
    first, rest = long[:1], long[1:]
    if comma:
        first, rest, sure = [i for i in long if i < cut], [i for i in long if i >= cut], True
        if not first or not rest:
            first, rest, sure = long[:1], long[1:], False
    elif not text.isupper():
        capital = [i for i in long if len(words[i]) > 1 and words[i].isupper()]
        if capital and len(capital) < len(long):
            first, rest, sure, swapped = [i for i in long if i not in capital], capital, True, capital[0] < long[-1]
    given, last = words[first[0]], " ".join(words[i] for i in rest)
    return {"a": plain(given), "b": plain(last), "swapped": swapped, "sure": sure, "initial": None, "middle": "".join(letter(i) for i in initials) or None, "spelt_a": spelt(given), "spelt_b": spelt(last)}


def one_edit(a: str, b: str) -> bool:
    """At most one letter missing, extra, swapped with its neighbour or mistyped."""
    return distance(a, b) <= 1


def distance(a: str, b: str) -> float:
    """Edits from a to b: letters missing, extra or swapped cost 1, replaced 1 by a neighbour on the keyboard or an e, else 2.2."""
    if a == b:
        return 0.0
    if abs(len(a) - len(b)) > 3:
        return 9.0
    last2: list[float] = []
    last = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [float(i)]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (0 if x == y else 1 if y in _NEAR.get(x, ()) or "e" in (x, y) else 2.2))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, last2[j - 2] + 1)
            row.append(d)
        last2, last = last, row
    return last[-1]


def deletions(word: str, most: int) -> set[str]:
    """The word and what is left of it after dropping up to ``most`` letters."""
    found, edge = {word}, {word}
    for _ in range(most):
        edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w))}
        found |= edge
    return found


def _index(words: list[str]) -> dict[str, list[int]]:
    """Words of a fixed list by what is left of them after dropping up to one letter."""
    found: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        for d in deletions(w, 1):
            found.setdefault(d, []).append(i)
    return found


_LONG_FORMS = [f for f in _FORM if len(f) > 5]
_RUN_TOGETHER = [(x, y) for x in FORMS for y in FORMS]
_NEAR_FORM, _NEAR_RUN = _index(_LONG_FORMS), _index([x + y for x, y in _RUN_TOGETHER])
_LONGEST = max(map(len, _NEAR_RUN)) + 1


@lru_cache(maxsize=500_000)
def form_of(word: str) -> str:
    """A plain word in the spelling of its legal form, also where it is one letter off or two forms are run together."""
    if word in _FORM or not 5 < len(word) <= _LONGEST:
        return _FORM.get(word, word)
    left = deletions(word, 1)
    first = lambda index, name: next((i for i in sorted({i for d in left for i in index.get(d, ())}) if one_edit(name(i), word)), None)
    if (i := first(_NEAR_FORM, _LONG_FORMS.__getitem__)) is not None:
        return _FORM[_LONG_FORMS[i]]
    if len(word) > 10 and (i := first(_NEAR_RUN, lambda i: "".join(_RUN_TOGETHER[i]))) is not None:
        return " ".join(_RUN_TOGETHER[i])
    return word


def read_organisation(name: str) -> list[str]:
    """The words of an organisation, legal forms in one spelling, without noise."""
    text = unicodedata.normalize("NFC", name)
    words = []
    for w in re.findall(r"[^\W_]+(?:[-'’][^\W_]+)*", re.sub(r"\b([^\W\d_])\.", r"\1", text)):
        p = plain(w)
        if p not in NOISE:
            words += form_of(p).split()
    return words


def is_form(word: str) -> bool:
    return word in FORMS


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Names to readings.  Organisations: a holds the sorted words, b the words in order."""
    columns = [c.split()[0] for c in READING.split(", ")]
    for frame in frames:
        out = []
        for name, organisation in zip(frame["name"], frame["organisation"]):
            if name is None or plain(" ".join(name.split())) in NO_NAMES or not any(c.isalpha() for c in name):
                continue
            words = read_organisation(name)
            if organisation or any(is_form(w) for w in words):
                if words:
                    own = [w for w in words if not is_form(w)] or words
                    marks = " ".join(w for w in (spelt(w) for w in re.findall(r"[^\W_]+", unicodedata.normalize("NFC", name))))
                    out.append((name, "o", " ".join(sorted(words)), " ".join(words), False, True, None, None, marks, own[0]))
                continue
            r = read_person(name)
            if r:
                out.append((name, "p", *[r[c] for c in columns[2:]]))
        yield pd.DataFrame(out, columns=columns)


#: Words of more letters than this meet over pieces instead of deletions, whose number grows with the square of the length.
PIECED = 40


def edit_keys(word: str, most: int) -> set[str]:
    """Keys of which any two words within ``most`` edits (1 or 2) share one.

    Short words: symmetric deletion.  Long words: cut into 2 * most + 1 pieces, of which such edits leave one
    whole (a swap may touch two), each piece also looked for where up to ``most`` letters more or less before
    it would put it.  Words near PIECED have both kinds, so no pair is lost where the kinds meet.
    """
    n, keys = len(word), set()
    if n <= PIECED + most:
        keys = deletions(word, most)
    if n > PIECED - most and most:
        parts = 2 * most + 1
        for whole in range(n - most, n + most + 1):
            cuts = [whole * i // parts for i in range(parts + 1)]
            for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                for shift in range(-most, most + 1):
                    if 0 <= lo + shift and hi + shift <= n:
                        keys.add(f"{whole}/{i}/{word[lo + shift : hi + shift]}")
    return keys


def _typo_keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Symmetric deletion: forms of which two keys share one if each part is within one edit, or the surname within two."""
    for frame in frames:
        out = []
        for k, g, s, weak in zip(frame["k"], frame["g"], frame["s"], frame["weak"]):
            forms = {f"{x}|{y}" for x in edit_keys(g, 1 if len(g) > 2 else 0) or {g} for y in edit_keys(s, 1)}
            if len(s) > 6:
                forms |= {f"{g}|{y}" for y in edit_keys(s, 2)}
            if len(g) > 5:
                forms |= {f"{x}|{s}" for x in edit_keys(g, 2)}
            out += [(k, weak, f) for f in forms]
        yield pd.DataFrame(out, columns=["k", "weak", "form"])


def _typo_cost(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        cost = [distance(a, b) + distance(c, d) for a, b, c, d in zip(frame["g"], frame["g2"], frame["s"], frame["s2"])]
        yield frame[["k", "k2", "f2", "n2"]].assign(long=frame["g"].str.len() + frame["s"].str.len(), cost=cost)


def _mend_marks(readings: DataFrame) -> DataFrame:
    """Words spelt out (oe for an o with marks) take the plain form, where the corpus has the marked word."""
    people = readings.where("kind = 'p'")
    whole = people
    part = lambda c: whole.select(F.explode(F.arrays_zip(F.split(f"spelt_{c}", " ").alias("x"), F.split(c, " ").alias("y"))).alias("z")).select("z.x", "z.y")
    table = part("a").union(part("b")).where("x != y").groupBy("x", "y").count()
    table = table.groupBy("x").agg(F.max_by("y", F.struct("count", "y")).alias("y"))
    for c in ("a", "b"):
        people = people.join(table.select(F.col("x").alias(c), F.col("y").alias("mended")), c, "left").withColumn(c, F.coalesce("mended", c)).drop("mended")
    return people


#: What a rewriting is worth where it fits one entity alone.
_SURE = {"nickname": 0.9, "initial": 0.9, "short form": 0.9}


def _score(when: Column, rule: str) -> Column:
    """The worth of the rule, a tenth less per edit, times the rarity of the mistyping."""
    return F.when(when, _SURE.get(rule, 1.0)).otherwise(1.0) * F.coalesce((1 - F.col("cost") / 10) * F.col("rarity"), F.lit(1.0))


def link_names(names: DataFrame) -> DataFrame:
    """The entity of every distinct name: name, entity, kind ('p' person, 'o' organisation), rule, confidence.

    ``names``: name STRING, organisation BOOLEAN (true where a source says so), n BIGINT (occurrences).
    Rewritings, each an equi-join: marks dropped or spelt out; titles dropped; the order of words turned;
    nicknames to full given names; full names to initials; legal forms to one spelling; organisations to
    their acronym or bare name; and spellings within a few edits by shared deletions.  A rewriting counts by
    its rarity: initials, bare names and nicknames link only where one entity alone has that form, and a
    mistyped key links to the nearest better attested one.  confidence is the worth of the rule (1, or 0.9
    for nicknames, initials and short forms) times its rarity, 1 / (entities that share the form); of a
    mistyping the target's share of the spellings of all equally near keys, less a tenth per edit.  Null, blank and letterless names, and names that can't be read, get no row.
    Repeated names count once, with their occurrences added up.

    Plan: everything runs on distinct names; forms are exploded in Arrow batches and joined by hash.  Initials,
    bare names and nicknames are counted per form first and joined to that one row, so a frequent form never
    pairs up; see _typo_links for mistypings.
    """
    names = names.where("name IS NOT NULL").groupBy("name").agg(F.max(F.coalesce("organisation", F.lit(False))).alias("organisation"), F.sum("n").alias("n"))
    readings = settle(names.select("name", "organisation").mapInPandas(_read, READING).join(names.select("name", "n"), "name"))
    return _people(readings).unionByName(_organisations(readings))


def _people(readings: DataFrame) -> DataFrame:
    people = settle(_mend_marks(readings))
    full = people.where("initial IS NULL")
    # 1. order: the two parts sorted are the key; which of them is the surname is voted by the key's readings
    low, high = F.least("a", "b"), F.greatest("a", "b")
    full = full.withColumn("k", F.concat_ws("|", low, high))
    vote = F.col("n") * F.when(F.col("sure"), 1000).otherwise(1)
    keys = full.groupBy("k").agg(
        F.sum(F.when(F.col("a") == low, vote).otherwise(-vote)).alias("v"), F.first(low).alias("x"), F.first(high).alias("y"), F.count(F.lit(1)).alias("f"), F.sum("n").alias("n")
    )
    # a word that is a known given name, or meets many partners, is no surname
    partners = keys.select(F.explode(F.array("x", "y")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    short = F.create_map(*[F.lit(z) for w, fs in _SHORT.items() for z in (w, ",".join(fs))])
    given = F.array(*[F.lit(w) for w in {*NICKNAMES, *_SHORT}])
    keys = keys.join(partners.select(F.col("w").alias("x"), F.col("c").alias("cx")), "x").join(partners.select(F.col("w").alias("y"), F.col("c").alias("cy")), "y")
    known_x, known_y = F.array_contains(given, F.col("x")), F.array_contains(given, F.col("y"))
    first_x = F.when(known_x & ~known_y, True).when(known_y & ~known_x, False).when(F.col("cx") > 8 * F.col("cy"), True).when(F.col("cy") > 8 * F.col("cx"), False).otherwise(F.col("v") >= 0)
    keys = settle(keys.select("k", F.when(first_x, F.col("x")).otherwise(F.col("y")).alias("g"), F.when(first_x, F.col("y")).otherwise(F.col("x")).alias("s"), "f", "n"))

    # 2. nicknames: to the full name that the corpus has with this surname, if one alone; else to the first
    nick = keys.withColumn("full", F.explode(F.split(F.element_at(short, F.col("g")), ",")))
    nick = nick.join(keys.select(F.col("g").alias("full"), "s", F.col("k").alias("to"), F.col("f").alias("tf"), F.col("n").alias("tn")), ["full", "s"], "left")
    nick = nick.groupBy("k", "s", "g").agg(F.count("to").alias("c"), F.max("to").alias("to"), F.min("full").alias("full"))
    virtual = F.concat_ws("|", F.least("full", "s"), F.greatest("full", "s"))
    nick = nick.where("c < 2").select("k", F.coalesce("to", virtual).alias("to"), F.col("full").alias("g2"))
    keys = keys.join(nick, "k", "left").select(F.coalesce("to", "k").alias("e"), "k", "s", F.when(F.col("to").isNotNull(), F.coalesce("g2", "g")).otherwise(F.col("g")).alias("g"), "f", "n", F.col("to").isNotNull().alias("nick"))
    keys = settle(keys)
    ents = keys.groupBy("e").agg(F.max_by("g", F.struct(~F.col("nick"), "n")).alias("g"), F.max_by("s", F.struct(~F.col("nick"), "n")).alias("s"), F.sum("f").alias("f"), F.sum("n").alias("n"))
    # an initial form with just this surname attests the surname
    ini = people.where("initial IS NOT NULL").withColumn("k", F.concat_ws("|", "b", "initial"))
    ikeys = settle(ini.groupBy("k", "b", "initial").agg(F.count(F.lit(1)).alias("f"), F.sum("n").alias("n")))
    ents = ents.withColumn("k", F.concat_ws("|", "s", F.substring("g", 1, 1))).join(ikeys.select("k", F.lit(1).alias("one")), "k", "left")
    ents = settle(ents.select("e", "g", "s", "f", "n", F.col("one").isNotNull().alias("attested")))

    # 3. typing errors: a key with a single spelling goes to the nearest better attested key
    typo = _typo_links(ents)
    ents = settle(ents.join(typo.select(F.col("k").alias("e"), F.col("to").alias("root"), "cost", "rarity"), "e", "left").withColumn("root", F.coalesce("root", "e")))
    roots = settle(ents.where("cost IS NULL").select("e", "g", "s", "f", "n"))

    # 4. initials: to the entity with this surname and initial, if one alone
    blocks = roots.groupBy(F.concat_ws("|", "s", F.substring("g", 1, 1)).alias("k")).agg(F.count(F.lit(1)).alias("c"), F.max("e").alias("to"))
    linked = settle(ikeys.join(blocks, "k", "left"))
    # 5. mistyped surnames of initial forms: to one better attested (surname, initial), initial forms included
    targets = linked.select("k", F.col("initial").alias("g"), F.col("b").alias("s"), "f", "n", F.when(F.col("c") == 1, F.col("to")).alias("to"), F.col("c").isNotNull().alias("known"))
    more = roots.select(F.concat_ws("|", "s", F.substring("g", 1, 1)).alias("k"), F.substring("g", 1, 1).alias("g"), "s", (F.col("f") + 1).alias("f"), "n").join(targets.select("k"), "k", "left_anti")
    more = more.groupBy("k", "g", "s").agg(F.sum("f").alias("f"), F.sum("n").alias("n")).select(F.col("k").alias("e"), "g", "s", "f", "n")
    pool = targets.select(F.col("k").alias("e"), "g", "s", (F.col("f") + F.when(F.col("known"), 2).otherwise(0)).alias("f"), "n").unionByName(more)
    slips = _typo_links(pool).select("k", F.col("to").alias("k2"), "cost", "rarity")
    linked = linked.select("k", "c", "to").join(slips.join(blocks.select(F.col("k").alias("k2"), F.col("c").alias("c2"), F.col("to").alias("to2")), "k2", "left"), "k", "left")
    free = F.col("c").isNull()
    linked = linked.select(
        "k",
        F.when(F.col("c") == 1, F.col("to")).when(free & (F.col("c2") == 1), F.col("to2")).when(free & F.col("k2").isNotNull() & F.col("c2").isNull(), F.concat(F.lit("i:"), "k2")).otherwise(F.concat(F.lit("i:"), "k")).alias("e"),
        F.when(F.col("c") == 1, F.lit("initial")).when(free & F.col("k2").isNotNull(), F.lit("initial, typing")).otherwise(F.lit("initials")).alias("rule"),
        (
            F.when(F.col("c") > 1, F.lit(1.0) / (F.col("c") + 1))
            .when(free & F.col("k2").isNotNull(), _SURE["initial"] * (1 - F.col("cost") / 10) * F.col("rarity"))
            .otherwise(_SURE["initial"])
        ).alias("confidence"),
    )
    by_initial = ini.join(linked, "k").select("name", F.concat(F.lit("p:"), "e").alias("entity"), F.lit("p").alias("kind"), "rule", "confidence")
    by_full = full.select("name", "k").join(keys.select("k", "e", "nick"), "k").join(ents.select("e", "root", "cost", "rarity"), "e")
    rule = F.when(F.col("cost").isNotNull(), F.lit("typing")).when(F.col("nick"), F.lit("nickname")).otherwise(F.lit("order and marks"))
    by_full = by_full.select("name", F.concat(F.lit("p:"), "root").alias("entity"), F.lit("p").alias("kind"), rule.alias("rule"), _score(F.col("nick"), "nickname").alias("confidence"))
    return by_full.unionByName(by_initial)


def _typo_links(ents: DataFrame) -> DataFrame:
    """k, to, cost, rarity: keys with few spellings and the better attested key they are a mistyping of.

    ``ents``: e (key), g, s (parts), f (distinct spellings), n (occurrences), and attested where other
    forms show that s is no mistyping.  A mistyping is a rewriting like the others: every key is rewritten to
    what its edits leave of it, keys meet over equal rewritings, and rarity is the share that the target has
    of the spellings of all keys that k can be rewritten to at that cost (1: no other key is as near).
    A rewriting is shared by at most as many distinct keys as letters can be put into it, so no form grows
    with the number of rows.
    """
    attested = F.col("attested") if "attested" in ents.columns else F.lit(False)
    keyed = settle(ents.select(F.col("e").alias("k"), "g", "s", "f", "n", attested.alias("attested")))
    # read twice, so written once; spread, because a row becomes many
    tasks = keyed.sparkSession.sparkContext.defaultParallelism
    spread = keyed.repartition(max(tasks, keyed.rdd.getNumPartitions()), "k").select("k", "g", "s", (F.col("f") == 1).alias("weak"))
    forms = settle(spread.mapInPandas(_typo_keys, "k string, weak boolean, form string").withColumn("form", F.xxhash64("form")))
    pairs = forms.where("weak").select("k", "form").join(forms.select("form", F.col("k").alias("k2")), "form").where("k != k2").select("k", "k2").distinct()
    two = keyed.select(F.col("k").alias("k2"), F.col("g").alias("g2"), F.col("s").alias("s2"), F.col("f").alias("f2"), F.col("n").alias("n2"), F.col("attested").alias("attested2"))
    weight, weight2 = F.col("f") + F.col("attested").cast("int"), F.col("f2") + F.col("attested2").cast("int")
    better = (F.col("f2") > 1) | (weight2 > weight) | ((weight2 == weight) & (F.struct("n2", "k2") > F.struct("n", "k")))
    pairs = pairs.join(keyed, "k").join(two, "k2").where(better).where("NOT attested OR s = s2")
    costs = settle(pairs.select("k", "k2", "g", "g2", "s", "s2", "f2", "n2").mapInPandas(_typo_cost, "k string, k2 string, f2 bigint, n2 bigint, long int, cost double").where("cost <= 2"))
    costs = costs.withColumn("rarity", F.col("f2") / F.sum("f2").over(Window.partitionBy("k", "cost")))
    best = Window.partitionBy("k").orderBy("cost", F.desc("rarity"), F.desc("n2"), "k2")
    one = costs.where("cost <= 1").withColumn("r", F.row_number().over(best)).where("r = 1").select("k", F.col("k2").alias("to"), "cost", "rarity")
    # what others are a mistyping of is attested by them; only the rest may be two edits from its key
    spent = one.select("k").union(one.select("to")).distinct()
    far = costs.where("cost > 1 AND long >= 12").join(spent, "k", "left_anti")
    far = far.withColumn("r", F.row_number().over(best)).where("r = 1").select("k", F.col("k2").alias("to"), "cost", "rarity")
    chosen = settle(one.unionByName(far))
    # a target that itself goes elsewhere hands on its own target, twice
    step = chosen.select(F.col("k").alias("to"), F.col("to").alias("next"))
    for _ in range(3):
        chosen = chosen.join(step, "to", "left").select("k", F.coalesce("next", "to").alias("to"), "cost", "rarity")
    return settle(chosen.where("k != to"))


def _organisations(readings: DataFrame) -> DataFrame:
    """Organisations: the sorted words are the key; acronyms, bare names and typing errors are rewritten to it."""
    orgs = readings.where("kind = 'o'").select("name", "n", F.split("b", " ").alias("w"), F.col("a").alias("k"))
    form = F.array(*[F.lit(x) for x in FORMS])
    # w: the order of words that most occurrences have; acronyms follow every order that occurs
    orders = settle(orgs.groupBy("k", "w").agg(F.count(F.lit(1)).alias("f"), F.sum("n").alias("n")))
    ks = settle(orders.groupBy("k").agg(F.max_by("w", F.struct("n", "w")).alias("w"), F.sum("f").alias("f"), F.sum("n").alias("n")))
    complete = ks.where(F.arrays_overlap("w", form))
    rest = ks.where(~F.arrays_overlap("w", form))
    # typing errors among complete names: forms stay, the own words vary
    split = complete.select(F.col("k").alias("e"), F.array_join(F.array_sort(F.filter("w", lambda z: F.array_contains(form, z))), " ").alias("g"), F.array_join(F.filter("w", lambda z: ~F.array_contains(form, z)), " ").alias("s"), "f", "n")
    typo = _typo_links(split.where("length(s) > 3"))
    # rewritings of complete names: one own word, alone or with the initials of the others in their order;
    # a form shared only by a name and its own mistypings is still rare, so only roots count
    root = typo.select("k", F.col("to").alias("r"), "cost", "rarity")
    own = settle(complete.select("k").join(root, "k", "left").select("k", F.coalesce("r", "k").alias("r"), F.col("r").isNotNull().alias("slip"), "cost", "rarity"))
    base = orders.where(F.arrays_overlap("w", form)).join(own.where("NOT slip").select("k"), "k", "left_semi")
    words = base.select("k", "w", F.explode(F.array_distinct(F.array_except("w", form))).alias("own"))
    others = F.filter("w", lambda z: z != F.col("own"))
    initials = F.transform(others, lambda z: F.substring(z, 1, 1))
    forms = words.select("k", F.col("own").alias("form")).union(words.select("k", F.array_join(F.array_sort(F.array("own", F.array_join(initials, ""))), " ").alias("form"))).union(words.select("k", F.array_join(F.array_sort(F.concat(F.array("own"), initials)), " ").alias("form")))
    rare = forms.distinct().groupBy("form").agg(F.count(F.lit(1)).alias("c"), F.max("k").alias("to"))
    short = rest.select("k").join(rare.select(F.col("form").alias("k"), "c", "to"), "k", "left")
    short = short.select("k", F.when(F.col("c") == 1, F.col("to")).otherwise(F.col("k")).alias("e"), F.when(F.col("c") == 1, F.lit("short form")).otherwise(F.lit("words")).alias("rule"), F.when(F.col("c") > 1, 1.0 / F.col("c")).when(F.col("c") == 1, _SURE["short form"]).otherwise(1.0).alias("confidence"))
    long = own.select("k", F.col("r").alias("e"), F.when(F.col("slip"), F.lit("typing")).otherwise(F.lit("words")).alias("rule"), _score(F.lit(False), "").alias("confidence"))
    return orgs.select("name", "k").join(long.unionByName(short), "k").select("name", F.concat(F.lit("o:"), "e").alias("entity"), F.lit("o").alias("kind"), "rule", "confidence")


def name_classes(links: DataFrame) -> DataFrame:
    """name, entity, kind, links: every name with its class and to how many other names that links it."""
    size = links.groupBy("entity").agg((F.count(F.lit(1)) - 1).alias("links"))
    return links.join(size, "entity").select("name", "entity", "kind", "links")


#: Names of one entity that one task pairs with the entity's other names.
SHARE = 1000


def name_pairs(links: DataFrame) -> DataFrame:
    """name_a < name_b of one entity; the names of an entity with many are dealt out over several tasks."""
    links = settle(links.select("entity", "name").distinct())
    size = links.groupBy("entity").agg(F.floor(F.count(F.lit(1)) / SHARE).cast("int").alias("last")).where("last > 0")
    dealt = links.join(size, "entity", "left").withColumn("last", F.coalesce("last", F.lit(0)))
    a = dealt.select("entity", F.pmod(F.xxhash64("name"), F.col("last") + 1).cast("int").alias("part"), F.col("name").alias("name_a"))
    b = dealt.select("entity", F.explode(F.sequence(F.lit(0), "last")).alias("part"), F.col("name").alias("name_b"))
    return a.join(b, ["entity", "part"]).where("name_a < name_b").select("name_a", "name_b").distinct()
