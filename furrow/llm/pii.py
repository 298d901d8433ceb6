"""PII surrogates: detected entities get keyed replacements of the same type, gender, script and format.

A surrogate is drawn from a keyed hash of (type, canonical entity, attempt), so the same entity reads the same
in every document (coreference) without any table; within a text, a name found once is then replaced wherever it stands alone. A global check over the distinct entities then looks for two
entities of a type with one surrogate, and for a surrogate that is itself an entity of the corpus; all but one
entity of such a clash draw again, until none is left (distinctness). Only entities that drew again, the
exceptions, have to be looked up when the texts are rewritten.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.common import Scratch, fresh, lean, using

# Given names by gender and script, family names by script, forms of address by gender.
GIVEN = {
    ("f", "latin"): "Alice Anna Barbara Carmen Charlotte Clara Claire Elena Elisabeth Emily Emma Greta Hannah Helen Ingrid Isabel Jane Julia Karen Laura Linda Lucia Margaret Maria Marie Mary Monika Nora Olivia Patricia Paula Petra Rosa Sarah Sofia Sophie Susan Teresa Ursula Victoria".split(),
    ("m", "latin"): "Adam Albert Andrew Anton Arthur Carlos Charles Daniel David Diego Edward Felix Frank Fritz George Henri Henry Hans Jack James Jean Johann John Jorge Joseph Karl Louis Lucas Manuel Michael Miguel Oliver Pablo Paul Peter Pierre Richard Robert Stefan Thomas William".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Ирина Ксения Лидия Мария Надежда Ольга Полина Светлана Татьяна Юлия".split(),
    ("m", "cyrillic"): "Алексей Борис Виктор Глеб Дмитрий Егор Иван Кирилл Михаил Николай Олег Павел Роман Сергей Юрий".split(),
}
FAMILY = {
    "latin": "Abbott Archer Bauer Becker Bennett Blanc Brandt Carter Castro Chapman Cole Cooper Delgado Dubois Ellis Faure Fischer Fletcher Garnier Gibson Graham Harper Hartmann Hayes Herrera Hoffmann Jensen Keller Klein Lambert Lopez Marchand Mason Mendoza Meyer Moreau Navarro Neumann Palmer Parker Ramos Reed Richter Rossi Roussel Santos Schmidt Serrano Shaw Stone Suarez Vargas Vogel Walker Weber Winter Wright Ziegler".split(),
    "cyrillic": "Белов Волков Громов Дроздов Ершов Зайцев Калинин Лебедев Морозов Никитин Орлов Петров Соколов Титов Фомин".split(),
}
ADDRESS = {
    "f": "Mrs Ms Miss Frau Madame Mme Señora Sra Dame".split() + ["г-жа"],
    "m": "Mr Herr Monsieur Señor Sr Sir".split() + ["г-н"],
    "": "Dr Prof".split(),
}

_GENDER = {n.casefold(): g for (g, _), names in GIVEN.items() for n in names}
_TITLE = {t: g for g, ts in ADDRESS.items() for t in ts}
_CAP = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][\w'’-]+"
_TITLED = re.compile(rf"\b({'|'.join(sorted(_TITLE, key=len, reverse=True))})\.? ({_CAP})(?: ({_CAP}))?")
_NAMED = re.compile(rf"\b({'|'.join(sorted({n for v in GIVEN.values() for n in v} | {n.upper() for v in GIVEN.values() for n in v}, key=len, reverse=True))}) ({_CAP})")
#: The same without a word's start in front: their first letters alone then tell where to look, which is much faster; what they find is looked at again.
_MAYBE_TITLED, _MAYBE_NAMED = (re.compile(p.pattern.removeprefix(r"\b")) for p in (_TITLED, _NAMED))
# Phrases that a person's name follows.
CUES = ("my name is", "i am called", "name:", "dear", "contact:", "attn:", "signed by", "mein name ist", "ich heiße", "liebe", "lieber", "je m'appelle", "chère", "cher", "me llamo", "mi nombre es", "querido", "querida", "меня зовут", "уважаемый", "уважаемая")
_CUE_FORMS = tuple(f"{form} " for c in CUES for form in dict.fromkeys((c, c.capitalize())))
_CUE_NAMES = re.compile(rf"({_CAP})(?: ({_CAP}))?")
_MAIL_LEFT, _MAIL_RIGHT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"), re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}")
_DIGITS = re.compile(r"[0-9]")
_PATTERNS = (
    ("secret", re.compile(r"""(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b)["']?[ \t]{0,4}[=:][ \t]{0,4}["']?(?P<x>[0-9A-Za-z_+/.-]{8,})"""), None),
    ("secret", re.compile(r"\b(?P<x>AKIA[0-9A-Z]{16})\b"), None),
    ("phone", re.compile(r"(?<![\w+])(?P<x>\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,3}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![\w-])"), None),
    ("phone", re.compile(r"(?<![\w+.-])(?P<x>0[1-9](?:[ .][0-9]{2}){4}|0[1-9][0-9]{1,3}[ /-][0-9]{5,8}|[6789][0-9]{2} [0-9]{3} [0-9]{3})(?![\w-])"), None),
    ("iban", re.compile(r"(?<!\w)(?P<x>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"), lambda x: _mod97(x) == 1),
    ("ssn", re.compile(r"(?<![\w-])(?P<x>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])"), None),
    ("ip", re.compile(r"(?<![\w.])(?P<x>[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})(?!\.?\w)"), lambda x: all(int(o) < 256 for o in x.split("."))),
    ("ipv6", re.compile(r"(?<![\w:.])(?P<x>(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:.])"), lambda x: x.count(":") <= 7),
    ("card", re.compile(r"(?<![\w.])(?P<x>[0-9](?:[ -]?[0-9]){12,18})(?![\w-])"), None),
)


def _mod97(x: str) -> int:
    """Of an account number, by its letters as numbers from 10 and its first four characters last: 1 if it is valid."""
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


def script(word: str) -> str:
    return "cyrillic" if any("\u0400" <= c <= "\u04ff" for c in word) else "latin"


def _places(text: str, forms: tuple[str, ...]) -> list[tuple[int, int]]:
    """Where any of some strings stands, not within a word or an address: (start, end)."""
    out = []
    for f in forms:
        at = text.find(f)
        while at >= 0:
            if not at or not (text[at - 1].isalnum() or text[at - 1] in "@.-_"):
                out.append((at, at + len(f)))
            at = text.find(f, at + 1)
    return out


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical form) of each entity, in order and apart; where two overlap, the earlier pattern wins."""
    found: list[tuple[int, int, str, str]] = []
    at = text.find("@")
    while at >= 0:
        right, left = _MAIL_RIGHT.match(text, at + 1), at
        while right and left and text[left - 1] in _MAIL_LEFT:
            left -= 1
        if right and left < at:
            found.append((left, right.end(), "email", text[left : right.end()].lower()))
        at = text.find("@", at + 1)
    if _DIGITS.search(text) or "=" in text or ":" in text:
        for kind, pattern, valid in _PATTERNS:
            if kind == "ipv6" and text.count(":") < 2:
                continue
            for m in pattern.finditer(text):
                x = m["x"]
                if valid is None or valid(x):
                    found.append((*m.span("x"), kind, x if kind in ("secret", "ip") else x.lower() if kind == "ipv6" else x.replace(" ", "") if kind == "iban" else re.sub(r"[^0-9+]", "", x)))
    for m in _TITLED.finditer(text) if _MAYBE_TITLED.search(text) else ():
        g = _TITLE[m[1]]
        names = [k for k in (2, 3) if m[k]]
        if len(names) == 2 and m[2].casefold() in _GENDER:
            found.append((*m.span(2), f"given-{_GENDER[m[2].casefold()]}-{script(m[2])}", m[2].casefold()))
            names = [3]
        elif len(names) == 2 and g:
            found.append((*m.span(2), f"given-{g}-{script(m[2])}", m[2].casefold()))
            names = [3]
        found += [(*m.span(k), f"family-{script(m[k])}", m[k].casefold()) for k in names]
    for m in _NAMED.finditer(text) if _MAYBE_NAMED.search(text) else ():
        found.append((*m.span(1), f"given-{_GENDER[m[1].casefold()]}-{script(m[1])}", m[1].casefold()))
        found.append((*m.span(2), f"family-{script(m[2])}", m[2].casefold()))
    for at in _places(text, _CUE_FORMS):
        m = _CUE_NAMES.match(text, at[1])
        if m is None:
            continue
        g = _GENDER.get(m[1].casefold())
        if m[2] is None and g is None:
            found.append((*m.span(1), f"family-{script(m[1])}", m[1].casefold()))
            continue
        found.append((*m.span(1), f"given-{g or 'fm'[zlib.crc32(m[1].casefold().encode()) % 2]}-{script(m[1])}", m[1].casefold()))
        if m[2] is not None:
            found.append((*m.span(2), f"family-{script(m[2])}", m[2].casefold()))
    known: dict[str, tuple[str, str]] = {}
    for a, b, k, c in found:
        if k.startswith(("given", "family")):
            for form in (text[a:b], c.title(), c.capitalize(), c.upper()):
                known.setdefault(form, (k, c))
    for a, b in _places(text, tuple(known)):  # the same person's names where they stand alone, capitalised
        if not (text[b : b + 1].isalnum() or text[b : b + 1] in ("@", "-", "_")):
            found.append((a, b, *known[text[a:b]]))
    out, end = [], 0
    for x in sorted(dict.fromkeys(found), key=lambda x: (x[0], -x[1])):
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return out


class Draw:
    """Numbers from a keyed hash of what they are for."""

    def __init__(self, key: bytes, *of: object):
        self.key, self.of, self.n, self.pool = key, "\x1f".join(map(str, of)).encode("utf-8", "replace"), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hashlib.blake2b(self.of + self.n.to_bytes(4, "little"), key=self.key[:64], digest_size=64).digest()
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:8], "little"), self.pool[8:]
        return x % n

    def like(self, text: str, keep: str = "") -> str:
        """Letters for letters of their case, digits for digits, the rest as it is; hexadecimal stays so."""
        hexa = len(text) >= 8 and re.fullmatch(r"(?=.*[a-f])(?=.*[0-9])[0-9a-f]+", text)
        out = []
        for c in text:
            if c in keep or not c.isascii() or not c.isalnum():
                out.append(c)
            elif hexa:
                out.append("0123456789abcdef"[self.below(16)])
            elif c.isdigit():
                out.append(str(self.below(10)))
            else:
                x = chr(97 + self.below(26))
                out.append(x.upper() if c.isupper() else x)
        return "".join(out)


def _luhn(digits: str) -> int:
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10


#: Attempts after which a surrogate may get longer, for formats with few strings.
WIDEN = 8


def first_attempt(kind: str, n: int) -> int:
    """The attempt that the n distinct entities of a kind start with: names are then long enough for four times as many."""
    part, *of = kind.split("-")
    if part not in ("given", "family"):
        return 0
    room, syllables = len(GIVEN[tuple(of)] if part == "given" else FAMILY[of[0]]), 0
    while room < 4 * n:
        room, syllables = 6 * room, syllables + 1
    return WIDEN * syllables if syllables > 1 else 0


def surrogate(key: bytes, kind: str, canon: str, attempt: int = 0) -> str:
    """The canonical surrogate of a canonical entity."""
    d = Draw(key, kind, canon, attempt)
    more = attempt // WIDEN
    if kind == "email":
        local, _, domain = canon.partition("@")
        labels = domain.split(".")
        kept = 2 if labels[-2:-1] == ["example"] else 1
        return d.like(local) + d.like("a" * more) + "@" + ".".join([*(d.like(x) for x in labels[:-kept]), *labels[-kept:]])
    if kind == "phone":
        head = re.match(r"\+1|\+[0-9]{2}|0[1-9]?|[6-9](?=[0-9]{8}\Z)|", canon)[0]
        if len(head) == 2 and head[0] == "0":  # national numbers go on with another digit than 0
            head = "0" + str(1 + d.below(9))
        rest = canon[len(head) :]
        if more:
            return head + d.like(rest + "0" * more)
        if len(rest) == 10 and rest[3:6] == "555":
            return head + str(2 + d.below(8)) + d.like(rest[1:3]) + "555" + d.like(rest[6:])
        return head + d.like(rest)
    if kind == "ip":
        a = int(canon.split(".")[0])
        first = a if a in (10, 127) and not more else next(x for x in iter(lambda: 1 + d.below(223), None) if x not in (10, 127, 172, 192))
        return ".".join(map(str, [first, d.below(256), d.below(256), 1 + d.below(254)]))
    if kind == "ssn":
        return str(1 + d.below(8)) + d.like(canon[1:]) + d.like("0" * more)
    if kind == "ipv6":
        return ":".join("".join("0123456789abcdef"[d.below(16)] for _ in part) for part in canon.split(":"))
    if kind == "iban":
        body = d.like(canon[4:]) + d.like("0" * min(more, 30 - len(canon)))
        return canon[:2] + f"{98 - _mod97(canon[:2] + '00' + body):02d}" + body
    if kind == "card":
        body = canon[0] + d.like(canon[1:-1])
        if _luhn(canon) == 0:
            return next(x for x in (body + str(c) for c in range(10)) if _luhn(x) == 0)
        return next(x for x in (body + str((d.below(10) + c) % 10) for c in range(10)) if _luhn(x))
    if kind == "secret":
        return "AKIA" + d.like(canon[4:]) if canon.startswith("AKIA") else d.like(canon) + d.like("a" * more)
    part, *of = kind.split("-")
    names = GIVEN[tuple(of)] if part == "given" else FAMILY[of[0]]
    tail = "".join(("ковинтарелос" if of[-1] == "cyrillic" else "bedilomarenu")[2 * x : 2 * x + 2] for x in (d.below(6) for _ in range(more)))
    return (names[d.below(len(names))] + tail).casefold()


def shaped(kind: str, original: str, canon: str) -> str:
    """The surrogate in the original's format: its separators, its case."""
    if kind == "iban":
        letters = iter(canon)
        return "".join([c if c == " " else next(letters, "") for c in original]) + "".join(letters)
    if kind == "ipv6":
        return canon.upper() if original.isupper() else canon
    if kind in ("phone", "card", "ssn"):
        digits = iter(canon.replace("+", ""))
        return "".join([next(digits, "0") if c.isdigit() else c for c in original]) + "".join(digits)
    if kind in ("email", "ip", "secret"):
        return canon.upper() if kind == "email" and original.isupper() else canon
    return canon.upper() if len(original) > 1 and original.isupper() else canon.title() if original[:1].isupper() else canon


def rewrite(text: str, key: bytes, attempts: dict[tuple[str, str], int], known: dict) -> tuple[str, int]:
    """The text with surrogates, and how many entities it had."""
    found = entities(text)
    if not found:
        return text, 0
    out, end = [], 0
    for a, b, kind, canon in found:
        k = (kind, canon)
        n = attempts.get(k, 0)
        if (*k, n) not in known:
            if len(known) > 50_000:
                known.clear()
            known[(*k, n)] = surrogate(key, kind, canon, n)
        out += [text[end:a], shaped(kind, text[a:b], known[(*k, n)])]
        end = b
    return "".join([*out, text[end:]]), len(found)


def settle(spark: SparkSession, scratch: Scratch, found: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, attempt) of the entities whose surrogate isn't that of attempt 0, from the distinct entities of the corpus. It goes on until no
    two clash: surrogates get longer with the attempts, and those of names start longer where there are many."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(sur=[surrogate(key, k, c, n) for k, c, n in zip(b["kind"], b["canon"], b["attempt"], strict=True)])

    schema = "kind string, canon string, attempt int, sur string"
    found = scratch.save(found.select("kind", "canon"))
    start = F.lit(0)
    for r in found.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect():  # one row a kind
        start = F.when(F.col("kind") == r["kind"], first_attempt(r["kind"], r["n"])).otherwise(start)
    now = scratch.save(found.withColumn("attempt", start.cast("int")).mapInPandas(draw, schema))
    while True:
        keys = now.select("kind", F.col("canon").alias("key"), F.lit(1).alias("own"), F.lit(0).alias("as"), F.lit(None).cast("string").alias("who"), F.lit(0).alias("n"))
        keys = keys.unionByName(now.select("kind", F.col("sur").alias("key"), F.lit(0).alias("own"), F.lit(1).alias("as"), F.col("canon").alias("who"), F.col("attempt").alias("n")))
        clash = keys.groupBy("kind", "key").agg(F.sum("own").alias("own"), F.sum("as").alias("as"), F.min(F.when(F.col("as") == 1, F.struct("n", "who"))).alias("first")).where("(own > 0 and `as` > 0) or `as` > 1")
        again = now.join(clash.select("kind", F.col("key").alias("sur"), F.when(F.col("own") == 0, F.col("first.who")).alias("stays")), ["kind", "sur"])
        again = scratch.save(again.where("stays is null or stays <> canon").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")))
        if again.isEmpty():
            return now.where("attempt > 0").select("kind", "canon", "attempt")
        moved = again.mapInPandas(draw, schema)
        now = scratch.save(now.join(again.select("kind", "canon"), ["kind", "canon"], "left_anti").select("kind", "canon", "attempt", "sur").unionByName(moved))


#: Exceptions that are sent to every task with the code; beyond it they are joined to the texts that need them.
SENT = 20_000


def pseudonymise(spark: SparkSession, docs: DataFrame, key: bytes, text_col: str = "text", sent: int = SENT, count_col: str = "n_entities") -> DataFrame:
    """All rows and columns of docs with the texts rewritten, and a last column count_col (long): how many entities were replaced. It takes an
    underscore in front if the table has a column of that name.

    Names are found by forms of address, by common given names and by phrases that a name follows; addresses, numbers and secrets by their form. A name
    without any of these isn't found, nor are parts of an e-mail address tied to a person.

    Null texts stay null with 0 entities, empty ones empty; repeated rows are each rewritten alike; null ids
    don't matter, as rows aren't looked up by id. An empty table gives none. Other columns, whatever their names, pass through. A very long text is searched
    whole, in memory some ten times its length. Only distinct entities, and
    beyond `sent` exceptions the texts that mention one, are shuffled.
    """
    count_col, hash_col, tries_col = fresh(docs, count_col, "_hash", "_attempts")
    scratch = Scratch(spark)
    texts = docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull())

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            using("pii")
            rows = dict.fromkeys((k, c) for t in b["text"] for _, _, k, c in entities(t))
            yield pd.DataFrame(list(rows), columns=["kind", "canon"])

    exceptions = settle(spark, scratch, texts.mapInPandas(lean(detect), "kind string, canon string").distinct(), key)
    schema = docs.withColumn(count_col, F.lit(0).cast("long")).schema
    place = docs.columns.index(text_col)

    def apply(own: dict):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            using("pii")
            known: dict = {}
            for b in batches:
                joined = b.schema.names[-1] == tries_col
                extra = b.column(b.num_columns - 1).to_pylist() if joined else [None] * b.num_rows
                made = [(t, 0) if t is None else rewrite(t, key, own if x is None else {(r["kind"], r["canon"]): r["attempt"] for r in x}, known) for t, x in zip(b.column(place).to_pylist(), extra, strict=True)]
                columns = b.columns[: len(b.columns) - joined]
                columns[place] = pa.array([m[0] for m in made], pa.string())
                yield pa.record_batch([*columns, pa.array([m[1] for m in made], pa.int64())], names=[*b.schema.names[: len(columns)], count_col])

        return run

    few = exceptions.limit(sent + 1).collect()
    if len(few) <= sent:
        return docs.mapInArrow(apply({(r["kind"], r["canon"]): r["attempt"] for r in few}), schema)

    def mentions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(h, k, c) for h, t in zip(b["_text"], b["text"], strict=True) for k, c in dict.fromkeys((x[2], x[3]) for x in entities(t))]
            yield pd.DataFrame(rows, columns=["_text", "kind", "canon"])

    said = texts.select(F.sha2("text", 256).alias("_text"), "text").mapInPandas(lean(mentions), "_text string, kind string, canon string").distinct()
    per = said.join(exceptions, ["kind", "canon"]).groupBy(F.col("_text").alias(hash_col)).agg(F.collect_list(F.struct("kind", "canon", "attempt")).alias(tries_col))
    joined = docs.withColumn(hash_col, F.sha2(F.col(text_col), 256)).join(scratch.save(per), hash_col, "left").select(*docs.columns, tries_col)
    return joined.mapInArrow(apply({}), schema)
