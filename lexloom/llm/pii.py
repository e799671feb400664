"""Personal data: detection and keyed, type-consistent surrogates.

Entities are e-mail addresses, telephone numbers (international ones, and national ones as written in English-speaking countries, Germany, France and
Spain), IPv4 addresses, payment card numbers
(with a valid check digit), IBANs (valid), US social security numbers, and names of people, in any script: all
names after a title (Mr, Mrs, Ms, Señor, Monsieur, Frau ...), initials and particles (von, de la) among them, names that begin with a common given name and go on, and all
other mentions of these full names and surnames in the same document.  A surrogate has the type, the length and the
punctuation of what it replaces: digits become digits and letters become letters of the same case and
script (vowels of names vowels); phone numbers keep their country code, cards and IBANs get valid check digits, addresses
keep their top-level domain, given names are replaced by given names of the same gender
and script.  It depends on a secret key, the type and the entity alone (through HMAC), so
one entity has the same surrogate in all documents.  A full name is drawn by parts: its surname is the
surname's own surrogate, wherever that stands alone, and its given names depend on the full name.

Collision checks: entities of the whole corpus are collected; where two have the same
surrogate, or a surrogate is itself an entity of the corpus, the later one (by its text) is
drawn again with the next attempt number, round after round until no clash is left (names give up
their length, and given names their list, after some attempts, as short ones could run out, so there is an end).  Only
these exceptions travel back to the documents, as all others follow from the key.

Nulls: a null text stays null; rows without doc_id keep their row.  Empty texts stay empty.
Very long texts are read whole.  Repeated rows are each replaced alike.  Ties: of entities that overlap, the first and then the longest counts.  Only ``doc_id`` and ``text`` are read, so other
columns never clash.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import string
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.storage import materialize

#: The setting of the session that holds the key, and the key of sessions without one (tests).  Set a key of your own: who has
#: it can tell which surrogate stands for a known entity.
KEY_SETTING = "spark.lexloom.pii.key"
KEY = "change-this-key"
#: Exceptions are sent to all executors up to so many; more are joined by document.
BROADCAST_ROWS = 200_000

FEMALE = ("Anna", "Emma", "Laura", "Sophie", "Marie", "Clara", "Julia", "Elena", "Alice", "Nora", "Carmen", "Ingrid", "Paula", "Helen", "Ruth", "Lucia", "Greta", "Camille", "Irene", "Grace")
MALE = ("Peter", "Paul", "Thomas", "Martin", "Louis", "Hugo", "David", "Oscar", "Felix", "Simon", "Carlos", "Hans", "Pierre", "James", "Henry", "Diego", "Otto", "Jules", "Robert", "Victor")
_TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mademoiselle": "f", "Señora": "f", "Sra": "f", "Señorita": "f", "Dr": "n", "Prof": "n",
    "Signor": "m", "Signore": "m", "Meneer": "m", "Doña": "f", "Signora": "f", "Signorina": "f", "Fräulein": "f", "Mevrouw": "f", "Mme": "f", "Mlle": "f", "Lady": "f", "Lord": "m",
}
#: Given names that tell a person without a title, by gender, besides those above.
_GIVEN = {n: "f" for n in FEMALE} | {n: "m" for n in MALE} | {n: "f" for n in (
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Margaret Sandra Ashley Emily Michelle Amanda Melissa Deborah Stephanie Rebecca Sharon Cynthia Kathleen Amy Angela Shirley Olivia Sophia Isabella Charlotte "
    "Hannah Lena Lea Katharina Sabine Ursula Monika Petra Renate Gisela Heike Birgit Claudia Nathalie Isabelle Sylvie Catherine Françoise Monique Chloé Léa Manon Juliette María Ana Isabel Pilar Dolores Teresa Rosa Cristina Marta Beatriz Rocío"
).split()} | {n: "m" for n in (
    "John Michael William Richard Joseph Charles Christopher Daniel Matthew Anthony Steven Andrew Joshua Kenneth Kevin Brian George Edward Ronald Timothy Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Oliver Liam Noah Lucas "
    "Jürgen Klaus Wolfgang Dieter Günther Uwe Stefan Andreas Matthias Sebastian Lukas Jonas Friedrich Jean Michel Philippe Alain Nicolas Julien Antoine François Laurent Olivier José Juan Antonio Manuel Francisco Javier Miguel Luis Pablo Alejandro Fernando Sergio Jorge"
).split()}


def _class(*kinds: str) -> str:
    """The characters of these Unicode categories, for use in brackets."""
    held = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in kinds]
    starts = [c for k, c in enumerate(held) if k == 0 or held[k - 1] != c - 1]
    ends = [c for k, c in enumerate(held) if k + 1 == len(held) or held[k + 1] != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))


_UP = _class("Lu", "Lt", "Lo")
_LETTER = _class("Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc")
_NAME = f"[{_UP}]['’]?[{_LETTER}]+(?:['’-](?!s(?![{_LETTER}]))[{_LETTER}]+)*(?![{_LETTER}])"

_PARTICLE = "(?:von|van|vom|zu|zum|zur|de|der|den|del|della|di|da|do|dos|du|des|la|le|las|los|el|al|bin|ibn|ter|ten|y)"
_INITIAL = rf"[{_UP}]\."
#: More of a name: names of any number, each perhaps after particles or initials.
_MORE = rf"(?: (?:{_PARTICLE} |{_INITIAL} ?)*{_NAME})"

PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*[A-Za-z0-9]@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ipv4": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z+])\+[0-9]{8,15}(?![0-9])"
    r"|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?(?:\(0\))?[ .-]?[0-9]{1,5}){2,6}(?![0-9])"
    r"|(?<![0-9A-Za-z+.,])(?:(?:0[1-9]|[679][0-9]{2})(?P<apart>[ .-])[0-9]{2}(?:(?P=apart)[0-9]{2}){2,3}|9[0-9][ .-][0-9]{3}[ .-][0-9]{2}[ .-][0-9]{2})(?![0-9]|[.,-][0-9])|(?<![0-9A-Za-z+.,])\(?0[1-9][0-9]{1,3}\)?[ /-]{1,3}[0-9]{4,9}(?:-[0-9]{1,4})?(?![0-9]|[.,-][0-9])",
}
_CODED = re.compile("|".join(f"(?P<{k}>{v})" for k, v in {k: (v.replace(r"\1", "(?P=gap)").replace("([ -]?)", "(?P<gap>[ -]?)")) for k, v in PATTERNS.items()}.items()))
_TITLE = "(?:" + "|".join(sorted(_TITLES, key=len, reverse=True)) + ")"
_TITLED = re.compile(rf"\b(?P<title>{_TITLE})\.? (?:{_TITLE}\.? )*(?!{_TITLE}\b)(?P<name>(?:{_INITIAL} ?|{_PARTICLE} )*{_NAME}{_MORE}*)")
#: Without what comes before and after, these are searched faster.
_ANY_TITLE, _ANY_GIVEN = re.compile(_TITLE), re.compile("|".join(sorted(_GIVEN, key=lambda n: (-len(n), n))))
_UNTITLED = re.compile(rf"(?<![{_LETTER}'’-])(?P<name>(?P<given>" + "|".join(sorted(_GIVEN, key=lambda n: (-len(n), n))) + rf")(?:-{_NAME})?{_MORE}+)")
_HINT = re.compile("[0-9@]")
#: Attempts after which a given name isn't taken from the lists, and after each of which a name gets one letter more.
_LISTED, _LONGER = 8, 4

_DRAWN = "kind string, entity string, gender string, mixed boolean, attempt int, drawn string"
Entity = tuple[int, int, str, str]


def luhn(digits: str) -> int:
    """The check digit for these digits."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def find_entities(text: str) -> list[Entity]:
    """(start, end, type, gender) of the entities of a text, in order and without overlap."""
    found: list[Entity] = []
    if _HINT.search(text):
        for m in _CODED.finditer(text):
            kind = next(k for k in PATTERNS if m.group(k) is not None)
            plain = re.sub("[ -]", "", m.group())
            if kind == "card" and luhn(plain[:-1]) != int(plain[-1]):
                continue
            if kind == "iban" and _iban_rest(plain) != 1:
                continue
            if kind == "phone" and not 7 <= sum(c in string.digits for c in plain) <= 15:
                continue
            found.append((m.start(), m.end(), kind, ""))
    names: dict[str, str] = {}
    for m in _TITLED.finditer(text) if _ANY_TITLE.search(text) else ():
        gender = _TITLES[m.group("title")]
        names[m.group("name")] = min(gender, names.get(m.group("name"), gender))
    for m in _UNTITLED.finditer(text) if _ANY_GIVEN.search(text) else ():
        names.setdefault(m.group("name"), _GIVEN[m.group("given")])
    if names:
        # titled or not, by full name or by surname
        known = {n.rsplit(" ", 1)[-1]: "" for n in names} | {n: g for n, g in names.items() if " " in n}
        mention = "|".join(re.escape(n) for n in sorted(known, key=lambda n: (-len(n), n)))
        for m in re.finditer(f"(?<![{_LETTER}])(?:{mention})(?![{_LETTER}])", text):
            found.append((*m.span(), "person" if " " in m.group() else "surname", known[m.group()]))
    found.sort(key=lambda e: (e[0], -e[1]))
    out: list[Entity] = []
    for e in found:
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def canonical(kind: str, value: str) -> str:
    """What makes two mentions the same entity."""
    if kind == "email":
        return value.lower()
    if kind in ("phone", "card", "iban", "ssn"):
        return re.sub(r"[^0-9A-Za-z+]", "", value).upper()
    return value


_ACCENTED, _ACCENTED_UP = "àáâäãåèéêëìíîïòóôöõùúûüñçčďěňřšťůžłńś", "ÀÁÂÄÃÅÈÉÊËÌÍÎÏÒÓÔÖÕÙÚÛÜÑÇČĎĚŇŘŠŤŮŽŁŃŚ"
_SPOKEN = ("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ")


class _Draw:
    """Keyed pseudo-random numbers for one entity and attempt."""

    def __init__(self, key: str, kind: str, entity: str, attempt: int):
        self._seed = hmac.new(key.encode(), f"{kind}\0{entity}\0{attempt}".encode(), hashlib.sha256).digest()
        self._left, self._block = b"", 0

    def below(self, n: int) -> int:
        if len(self._left) < 4:
            self._left = hashlib.sha256(self._seed + self._block.to_bytes(4, "big")).digest()
            self._block += 1
        value, self._left = int.from_bytes(self._left[:4], "big"), self._left[4:]
        return value % n

    def pick(self, of: str) -> str:
        return of[self.below(len(of))]

    def spoken(self, c: str) -> str:
        """A letter of a name: vowels become vowels."""
        for of in _SPOKEN:
            if c in of:
                return self.pick(of)
        return self.like(c)

    def like(self, c: str) -> str:
        """A character of the same class, case and script; others stay."""
        if c in string.digits:
            return string.digits[self.below(10)]
        if c in string.ascii_lowercase:
            return string.ascii_lowercase[self.below(26)]
        if c in string.ascii_uppercase:
            return string.ascii_uppercase[self.below(26)]
        if c in _ACCENTED:
            return self.pick(_ACCENTED)
        if c in _ACCENTED_UP:
            return self.pick(_ACCENTED_UP)
        if c.isalpha():
            block = unicodedata.name(c, "").split(" ")[0]
            for _ in range(64):
                other = chr(ord(c) - 12 + self.below(25))
                if other.isalpha() and other.isupper() == c.isupper() and unicodedata.name(other, "").split(" ")[0] == block:
                    return other
        return c


def surrogate(key: str, kind: str, entity: str, gender: str = "", attempt: int = 0) -> str:
    """The surrogate of a canonical entity, in canonical form."""
    draw = _Draw(key, kind, entity, attempt)
    if kind == "email":
        local, domain = entity.rsplit("@", 1)
        host, top = domain.rsplit(".", 1)
        return f"{''.join(map(draw.like, local))}@{''.join(map(draw.like, host))}.{top}"
    if kind == "ipv4":
        private = next((p for p in ("10.", "192.168.", "127.") if entity.startswith(p)), "")
        parts = entity.split(".")
        fixed = private.count(".")
        return ".".join(parts[:fixed] + [str(1 + draw.below(254) if k in (0, 3) else draw.below(256)) for k in range(fixed, 4)])
    if kind == "card":
        body = entity[0] + "".join(map(draw.like, entity[1:-1]))
        return body + str(luhn(body))
    if kind == "iban":
        body = entity[:2] + "00" + "".join(map(draw.like, entity[4:]))
        return f"{entity[:2]}{98 - _iban_rest(body):02d}{body[4:]}"
    if kind == "phone":
        keep = (len(entity) - 10 if len(entity) > 11 else 2) if entity.startswith("+") else 0
        first = entity[keep : keep + 1]
        return entity[:keep] + (str(1 + draw.below(9)) if first not in ("", "0") else first) + "".join(map(draw.like, entity[keep + 1 :]))
    if kind == "person":
        # the surname stays here, so that only equal given names of one surname clash
        given, surname = entity.rsplit(" ", 1)
        out = []
        for k, word in enumerate(given.split(" ")):
            latin = all(unicodedata.name(c, "").startswith("LATIN") for c in word if c.isalpha())
            if word[0].islower():
                out.append(word)
            elif k == 0 and latin and len(word.rstrip(".")) > 1 and attempt < _LISTED:
                out.append(draw.pick(FEMALE if gender == "f" else MALE if gender == "m" else FEMALE + MALE))
            else:
                out.append("".join(map(draw.spoken, word if word.endswith(".") else word + word[-1] * (attempt // _LONGER))))
        return " ".join([*out, surname])
    if kind == "surname":
        return "".join(map(draw.spoken, entity + entity[-1] * (attempt // _LONGER)))
    return "".join(map(draw.like, entity))


def shaped(kind: str, value: str, replacement: str) -> str:
    """A canonical surrogate in the format of the mention."""
    if kind == "email":
        return "".join(r.upper() if c.isupper() else r for c, r in zip(value, replacement, strict=True))
    if kind in ("phone", "card", "iban", "ssn"):
        left = iter(replacement)
        return "".join(next(left) if re.match(r"[0-9A-Za-z+]", c) else c for c in value)
    return replacement


def parts(kind: str, entity: str, gender: str) -> list[tuple[str, str, str]]:
    """(type, entity, gender) of what is drawn for a canonical entity."""
    return [(kind, entity, gender)] + ([("surname", entity.rsplit(" ", 1)[1], "")] if kind == "person" else [])


def replace(text: str, key: str, odd: dict[tuple[str, str], tuple[str, int]]) -> tuple[str, int]:
    """The text with surrogates, and how many entities it had; odd: (gender, attempt) of exceptions."""
    out, at = [], 0
    found = find_entities(text)
    for start, end, kind, gender in found:
        value = text[start:end]
        entity = canonical(kind, value)
        drawn = [surrogate(key, k, e, *odd.get((k, e), (g, 0))) for k, e, g in parts(kind, entity, gender)]
        new = f"{drawn[0].rsplit(' ', 1)[0]} {drawn[1]}" if kind == "person" else drawn[0]
        out += [text[at:start], shaped(kind, value, new)]
        at = end
    return ("".join([*out, text[at:]]), len(found)) if found else (text, 0)


def _collect(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                value = text.as_py()
                for start, end, kind, gender in find_entities(value) if value else ():
                    rows.update((doc, *p) for p in parts(kind, canonical(kind, value[start:end]), gender))
            if rows:
                docs, kinds, entities, genders = zip(*rows, strict=True)
                drawn = [surrogate(key, k, e, g) for _, k, e, g in rows]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *(pa.array(c, pa.string()) for c in (kinds, entities, genders, drawn))], names=["doc_id", "kind", "entity", "gender", "drawn"])

    return run


def _redraw(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, entities, genders, _, attempts = (c.to_pylist() for c in batch.columns)
            drawn = [surrogate(key, *x) for x in zip(kinds, entities, genders, attempts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(drawn, pa.string())], names=["kind", "entity", "gender", "mixed", "attempt", "drawn"])

    return run


def exceptions(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, gender, attempt) where the first surrogate clashes, with the attempt that doesn't, or where genders differ.

    A person with titles of both kinds, or with and without a gender, gets one: female before
    male before neither.
    """
    every = entities.groupBy("kind", "entity").agg(F.min("gender").alias("gender"), F.max("gender").alias("other"), F.min_by("drawn", "gender").alias("drawn"))
    now = materialize(every.withColumn("mixed", F.col("gender") != F.col("other")).drop("other").withColumn("attempt", F.lit(0)), "pii-entities")
    real = now.select("kind", F.col("entity").alias("drawn"), F.lit(True).alias("real"))
    while True:
        # entities that were drawn anew yield to those that were not
        order = Window.partitionBy("kind", "drawn").orderBy("attempt", "entity")
        marked = now.withColumn("place", F.row_number().over(order)).join(real, ["kind", "drawn"], "left")
        clash = (F.col("place") > 1) | F.col("real").isNotNull()
        marked = materialize(marked.select("kind", "entity", "gender", "mixed", "attempt", "drawn", clash.alias("clash")), "pii-clashes")
        if marked.where("clash").isEmpty():
            return marked.where("mixed OR attempt > 0").select("kind", "entity", "gender", "attempt")
        again = marked.where("clash").select("kind", "entity", "gender", "mixed", (F.col("attempt") + 1).alias("attempt")).mapInArrow(_redraw(key), _DRAWN)
        now = materialize(marked.where("NOT clash").select("kind", "entity", "gender", "mixed", "attempt", "drawn").union(again), "pii-entities")


def _apply(key: str, held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere = held.value if held is not None else {}
        for batch in batches:
            texts, counts = [], []
            own = batch.column(2).to_pylist() if held is None else None
            for k, text in enumerate(batch.column(1)):
                value = text.as_py()
                odd = everywhere if own is None else {(x["kind"], x["entity"]): (x["gender"], x["attempt"]) for x in own[k] or ()}
                new, n = (value, 0) if value is None else replace(value, key, odd)
                texts.append(new)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["doc_id", "text", "n_replaced"])

    return run


def replace_personal_data(docs: DataFrame, key: str | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, text, n_replaced) of every row; the key comes from the session unless given."""
    key = key or docs.sparkSession.conf.get(KEY_SETTING, KEY)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialize(rows.mapInArrow(_collect(key), "doc_id long, kind string, entity string, gender string, drawn string"), "pii-mentions")
    odd = materialize(exceptions(found, key), "pii-exceptions")
    schema = "doc_id long, text string, n_replaced int"
    if odd.count() <= broadcast_rows:
        held = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["entity"]): (r["gender"], r["attempt"]) for r in odd.toLocalIterator()})
        return rows.mapInArrow(_apply(key, held), schema)
    per_doc = found.select("doc_id", "kind", "entity").join(odd, ["kind", "entity"]).groupBy("doc_id").agg(F.collect_set(F.struct("kind", "entity", "gender", "attempt")).alias("own")).withColumnRenamed("doc_id", "of")
    joined = rows.join(per_doc.hint("shuffle_hash"), rows["doc_id"].eqNullSafe(per_doc["of"]), "left").select("doc_id", "text", "own")
    return joined.mapInArrow(_apply(key, None), schema)


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
