"""Personal data in free text: found by weak supervision, replaced by typed placeholders.

Broad patterns propose candidate spans. Labelers vote on each: its shape, a gazetteer or public numbering plan, the
nearest label before it, what follows it, and other personal data nearby. Expectation-maximisation over the counts of
all vote patterns (two classes, one reliability table a labeler) gives each pattern its probability. A logistic span
classifier learns these probabilities from the votes and the neighbouring words, and decides; of overlapping spans the
likelier one stays.

Every text is read whole. Vote counts cover all candidates; only the classifier's fit uses a sample (FIT_SPANS a
kind). The gazetteer is read from a table of people: given names propose and surnames vote, both as whole words. A
document gets the known names among its own capitalised tokens: by broadcast when there are at most GAZETTEER names,
else by a join of the tokens with the whole table of names.

Defined results
    * text null, empty or without candidates: no spans, and the text unchanged.
    * a run that occurs several times in a document: one row in ``found_spans``, masked at every place.
    * repeated doc ids: judged apart, equal rows reported once. Other columns are ignored.
    * no gazetteer (null names or an empty table): names with initials and the other kinds are still found.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litweave.runtime import materialise, skew_join, spread

KINDS = ("email", "phone", "id_number", "address", "person")
LABELERS = ("shape", "gazetteer", "before", "after", "near")
FIT_SPANS, GAZETTEER, CONTEXT = 10_000, 100_000, 512
#: Characters before and after a span that its labels are looked for in.
BEFORE, AFTER = 56, 40
SPANS = "array<struct<kind:int,a:int,b:int,run:string,votes:string,ctx:array<int>>>"

# General words, labels and written forms in English, German, French, Spanish and Japanese.
STREET = r"(?:Street|St\.|St\b|Road|Rd\b(?:\.(?=,))?|Lane|Ln\b(?:\.(?=,))?|Avenue|Ave\b(?:\.(?=,))?|Drive|Dr\b(?:\.(?=,)|(?=,|\s*\n|\s*\Z))|Close|Court|Ct\b(?:\.(?=,))?|Hill|Way|Place|Square|Terrace|Crescent|Gardens|Grove|Row|Walk|Parkway|Pkwy\b|Mews|Boulevard|Blvd\b(?:\.(?=,))?)"
STREET_DE = r"(?:stra(?:ss|ß)e|str\.|platz|weg|gasse|allee|ring|damm|ufer)"
STREET_FR = r"(?:rue|avenue|av\.|bd|boulevard|place|allée|chemin|quai|impasse|route|cours|square)"
STREET_ES = r"(?:[Cc]alle|CALLE|[Cc]/|[Aa]vda\.|AVDA\.|[Aa]v\.|AV\.|[Aa]venida|AVENIDA|[Pp]laza|PLAZA|[Pp]za\.|PZA\.|[Pp]aseo|PASEO|P\.º|[Cc]amino|CAMINO|[Rr]onda|RONDA|[Tt]raves[ií]a|TRAVES[IÍ]A)"
PARTICLES = r"(?:van|von|vom|zu|de|del|della|der|den|di|da|dos|du|la|le|ter|ten|af|av|al|el|bin|ben)"

#: Labels that announce a kind, as one or two plain words.
ANNOUNCED = {
    "email": "email, e mail, mail, mailto, courriel, courrier, correo, contact, kontakt, contacto, write, cc, from, reply, 連絡先, メール",
    "phone": "tel, telephone, phone, mobile, cell, cellphone, fax, telefax, handy, telefon, telefono, movil, portable, ring, call, called, dial, text, sms, whatsapp, hotline, landline, reach, reached, my number, new number, your number, his number, her number, our number, rufnummer, durchwahl, mobil, mobiltelefon, appelez, appeler, llame, llamar, rufen, anrufen, 電話, 携帯, ファックス",
    "id_number": "id, ids, ssn, sin, passport, identity, identification, insurance, tax, taxpayer, personal, personnel, employee, staff, social, ni, nino, licence, license, dni, nie, nif, cpf, curp, bsn, matricule, ausweisnummer, ausweis, personalausweis, personalnummer, reisepass, steuernummer, steuer, sozialversicherungsnummer, versicherungsnummer, identite, securite, passeport, pasaporte, identidad, 旅券番号, 社員番号, マイナンバー",
    "address": "lives, live, living, lived, resident, resides, residing, home, house, address, adresse, anschrift, direccion, domicilio, domicile, wohnt, wohnhaft, habite, demeurant, reside, vive, moved, delivery, deliver, ship, shipped, visit, 住所",
    "person": "dear, dr, prof, professor, mr, mrs, ms, miss, sir, herr, herrn, frau, mme, mlle, monsieur, madame, m, sr, sra, senor, senora, don, signed, sincerely, regards, from, to, by, with, contact, kontakt, contacto, name, named, author, authors, von, par, por, attn, attention, thank, thanks, danken, dank, remercions, merci, agradecemos, gracias, inventor, applicant, holder, inhaber, titular, patient, volunteer, participant, employee, colleague, ask, asked, told, called, meet, met, gruss, grussen, cordialement, atentamente, an, 担当",
}
#: Words that announce a number, name or code of something else.
THINGS = "lot, cas, issn, isbn, grant, agreement, award, contract, project, serial, sn, doi, pp, page, pages, vol, volume, issue, batch, sample, samples, run, peak, peaks, count, counts, band, bands, reading, readings, value, values, part, parts, catalogue, catalog, cat, article, order, ref, reference, fig, figure, figures, table, eq, equation, version, firmware, model, patent, claim, section, chapter, invoice, row, line, code, zip, postcode, experiment, scan, ratio, range, step, wavelength, frequency, temperature, mass, charge, chargennummer, probe, lote, muestra, echantillon, numero de, serie, between, approximately, roughly"
#: Words after a span that tell of something else: units, and what is named after people.
UNITS = "nm, mm, cm, km, kg, mg, ml, mol, hz, khz, mhz, ghz, kv, mv, ev, kev, pa, mpa, gpa, wt, rpm, usd, eur, percent, counts, cycles, samples, units"
EPONYMS = "et, plot, plots, model, models, method, methods, effect, effects, equation, law, rule, theorem, test, group, sample, samples, diagram, transition, temperature, constant, function, distribution, process, scattering, spectroscopy, syndrome, disease, street, road"
#: Words that are capitalised at the start of a sentence or line and are no surnames.
ORDINARY = "a, about, according, after, all, also, although, an, and, annealing, another, as, at, because, before, below, best, beyond, both, but, by, calculations, compared, contact, correspondence, data, dear, during, each, figure, for, from, further, he, her, here, high, his, home, however, i, if, in, inside, it, its, kind, many, measurements, more, most, my, no, not, of, on, one, only, or, other, our, over, please, results, samples, she, since, sincerely, so, some, such, table, thank, thanks, that, the, their, then, there, these, they, this, those, to, two, under, until, using, we, when, where, which, while, who, why, will, with, within, without, yes, you, your, applicant, holder, inventor, regards, signed, street, road, university, institute, department, das, dem, den, der, des, die, ein, eine, es, fur, im, inhaber, ist, mit, nach, unter, wir, zur, au, aux, avec, cette, ces, dans, il, la, le, les, lors, nous, par, pour, sur, un, une, al, con, el, en, este, estos, la, las, los, para, por, se, sin, su, titular, una"


def _listed(text: str) -> list[str]:
    return [w.strip() for w in text.split(",")]


_DOT = r"(?:\.|\s*[\[({]\s*dot\s*[\])}]\s*|\s+dot\s+)"
_WORD = r"[A-Za-z0-9_%+-]+"
_TLD = r"(?:xn--[A-Za-z0-9-]+|[A-Za-z]{2,})"  # public rule: top-level names are letters
_EMAIL = {
    "plain": re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+{_TLD}(?![A-Za-z0-9]|[.-][A-Za-z0-9])"),
    "written": re.compile(rf"(?<![A-Za-z0-9._%+@-]){_WORD}(?:{_DOT}{_WORD})*\s*[\[({{]\s?(?:at|@)\s?[\])}}]\s*[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]*[A-Za-z0-9])+", re.I),
    "spoken": re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9_%+-]+(?:(?:\s+dot\s+|\.)[A-Za-z0-9_%+-]+)*\s+at\s+[A-Za-z0-9-]+(?:(?:\s+dot\s+|\.)[A-Za-z0-9-]*[A-Za-z0-9])*\s+dot\s+[A-Za-z0-9-]*[A-Za-z0-9]", re.I),
    "odd": re.compile(r"(?<!\S)[^\s@<>]+@[^\s@<>]+"),
}
_BRACKET_AT = re.compile(r"[\[({]\s?(?:at|@)\s?[\])}]")
#: Where a telephone or identity number can lie at all: six signs or more of digits and what parts them.
_RUN = re.compile(r"\d[\d\s.\-/()]{4,}\d")
_PHONE = {
    "plus": re.compile(r"(?<![A-Za-z0-9+])\+\d{1,3}(?:\s*\(\d{1,4}\)\s*)?(?:[\s.\-/]?\d){6,12}(?![A-Za-z0-9])"),
    "zeros": re.compile(r"(?<![A-Za-z0-9+.\-/])00[1-9]\d(?:\s\d{2,6}){2,4}(?![A-Za-z0-9])"),
    "area": re.compile(r"(?<![A-Za-z0-9])\(\d{3}\)\s*\d{3}[\s.\-]\d{4}(?![A-Za-z0-9])"),
    "three": re.compile(r"(?<![A-Za-z0-9+.\-/(])\d{3}([.\-\s])\d{3}\1\d{4}(?![A-Za-z0-9]|[.\-/]\d)"),
    "trunk": re.compile(r"(?<![A-Za-z0-9+.\-/])0[1-9]\d{1,3}[\s/]\d{3,6}(?:[\s\-]\d{2,4})?(?![A-Za-z0-9]|[.\-/]\d)"),
    "bracket": re.compile(r"(?<![A-Za-z0-9+.\-/])\(0[1-9]\d{0,4}\)\s?\d{3,8}(?:[\s\-]\d{3,4})?(?![A-Za-z0-9]|[.\-/]\d)"),
    "pairs": re.compile(r"(?<![A-Za-z0-9+.\-/])0[1-9](?:([.\s\-])\d\d)(?:\1\d\d){3}(?![A-Za-z0-9]|[.\-/]\d)"),
    "hyphen": re.compile(r"(?<![A-Za-z0-9+.\-/])0[1-9]\d{0,3}-\d{2,4}-\d{4}(?![A-Za-z0-9]|[.\-/]\d)"),
    "labelled": re.compile(r"(?<![A-Za-z0-9+.\-/(])\d{2,5}(?:[^\S\n]?[.\-/]?\d{2,5}){1,5}(?![A-Za-z0-9]|[.\-/]\d)"),
    "odd": re.compile(r"(?<![A-Za-z0-9+.\-/(])\d{2,3}(?:[.\-\s]\d{3,4}){2,3}(?![A-Za-z0-9]|[.\-/]\d)"),
}
_ID = {
    "letters": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\s?\d\d\s?\d\d\s?\d\d\s?[A-D](?![A-Za-z0-9])"),
    "three": re.compile(r"(?<![A-Za-z0-9+.\-/(])\d{3}([\s\-])\d{2}\1\d{4}(?![A-Za-z0-9]|[.\-/]\d)"),
    "birth": re.compile(r"(?<![A-Za-z0-9+.\-/(])[0-3]\d[01]\d\d\d[-+]\d{4}(?![A-Za-z0-9]|[.\-/]\d)"),
    "insurance": re.compile(r"(?<![A-Za-z0-9+.\-/(])\d{2}([\s\-])\d{4}\1\d{4}\1\d(?![A-Za-z0-9]|[.\-/]\d)"),
    "pass": re.compile(r"(?<![A-Za-z0-9])[A-Z]{1,2}\d{7}(?![A-Za-z0-9]|-)"),
    "check": re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]\d{7}|\d{8})-?[A-Z](?![A-Za-z0-9])"),
    "labelled": re.compile(r"(?<![A-Za-z0-9+.\-/(])(?:\d{1,5}(?:[^\S\n]?[.\-/]?\d{1,5}){1,7}(?:[^\S\n]?[.\-/]?[A-Z])?|[A-Z]{1,3}-?\d{5,12})(?![A-Za-z0-9]|[.\-/]\d)"),
    "odd": re.compile(r"(?<![A-Za-z0-9+.\-/(])(?:[A-Z]{2}-)?\d{2,7}-\d{2,7}(?:-\d{1,4}){0,2}(?![A-Za-z0-9]|[.\-/]\d)"),
}
#: Codes of letters and digits, read only after such a label.
_CODE = re.compile(r"(?:passport|passeport|pasaporte|reisepass|personalausweis|ausweis|identity|licen[cs]e|dni|\bid|insurance)(?:nummer)?(?:\s+card)?\W{0,3}(?:no|number|nr|num[eé]ro|n[uú]mero|n°|nº)?\W{0,3}(?-i:((?=[A-Z0-9]*[A-Z])(?=(?:[A-Z]*\d){4})[A-Z0-9]{7,12})(?![A-Za-z0-9-]))", re.I)
#: Space inside a run: any blanks, with one line break at most.
_GAP = r"(?:[^\S\r\n]+(?:\r?\n[^\S\r\n]*)?|\r?\n[^\S\r\n]*)"
_STREETNAME = r"\p{Lu}[\p{L}'’-]+"
_ADDRESS = {
    "number first": re.compile(rf"(?<![\p{{L}}\p{{N}}.,\-/])\d{{1,5}}[A-Za-z]?{_GAP}(?:(?:[NSEW]\.|(?i:North|South|East|West|Old|New|Upper|Lower|Great|Little)){_GAP}){{0,2}}(?:{_STREETNAME}{_GAP}){{1,3}}?(?i:{STREET})(?!\p{{L}})"),
    "french": re.compile(rf"(?<![\p{{L}}\p{{N}}.,\-/])\d{{1,4}}[A-Za-z]?\b(?:{_GAP}(?i:bis|ter|quater)\b)?,?{_GAP}(?i:{STREET_FR}){_GAP}(?:(?i:de{_GAP}la|de{_GAP}l['’]|des|du|de|la|le)(?:{_GAP})?|(?i:d['’]|l['’]))?{_STREETNAME}(?!\p{{L}})"),
    "german": re.compile(rf"(?<![\p{{L}}\p{{N}}])\p{{Lu}}\p{{L}}+?(?:-\p{{Lu}}\p{{L}}+)*?-?(?i:{STREET_DE}){_GAP}\d{{1,4}}(?:[A-Za-z](?![\p{{L}}\d]))?(?!\d)"),
    "spanish": re.compile(rf"(?<![\p{{L}}\p{{N}}]){STREET_ES}(?:{_GAP})?(?:(?i:de{_GAP}la|de{_GAP}los|de{_GAP}las|del|de){_GAP})?{_STREETNAME}(?:{_GAP}{_STREETNAME})?,?{_GAP}(?:(?i:n\.º|n[oº°]\.?|núm\.)(?:{_GAP})?)?\d{{1,4}}(?:[A-Za-z](?![\p{{L}}\d]))?(?!\d)"),
    "odd": re.compile(r"(?<![\p{L}\p{N}])\p{Lu}[\p{L}'’-]+\s+(?:Street|Road|Lane|Avenue|Drive|Close|Court|Hill)(?!\p{L})(?:\s+\d+)?"),
}
#: What a text in lower case must hold for a pattern to be tried at all.
_NEEDS = {
    "french": lambda t: "rue" in t or "avenue" in t or "av." in t or "bd" in t or "boulevard" in t or "place" in t or "allée" in t or "chemin" in t or "quai" in t or "impasse" in t or "route" in t or "cours" in t or "square" in t,
    "german": lambda t: "stra" in t or "str." in t or "platz" in t or "weg" in t or "gasse" in t or "allee" in t or "ring" in t or "damm" in t or "ufer" in t,
    "spanish": lambda t: "calle" in t or "c/" in t or "avda" in t or "av." in t or "avenida" in t or "plaza" in t or "pza" in t or "paseo" in t or "p.º" in t or "camino" in t or "ronda" in t or "traves" in t,
    "odd": lambda t: " street" in t or " road" in t or " lane" in t or " avenue" in t or " drive" in t or " close" in t or " court" in t or " hill" in t,
}
_CAP = r"(?:(?i:al|el|ibn)-)?\p{Lu}[\p{L}'’]+(?:-\p{Lu}[\p{L}'’]+)*"
_SURNAME = rf"(?:(?i:{PARTICLES}){_GAP}){{0,3}}{_CAP}"
_INITIALS = r"\p{Lu}\.(?:[^\S\r\n]?-?\p{Lu}\.){0,3}"
_TOKEN = re.compile(r"(?<![\p{L}\p{N}])\p{Lu}\p{L}*(?:-\p{L}+)*(?![\p{L}\p{N}])")
_NAME, _WHOLE = re.compile(r"\p{Lu}[\p{L}'’]+"), re.compile(_CAP)
_INIT = re.compile(rf"(?<![\p{{L}}\p{{N}}.])(?<!\p{{Lu}}\.[\s-]?){_INITIALS}")
_THEN = re.compile(rf"(?:{_GAP}{_INITIALS})?{_GAP}({_SURNAME})(?![\p{{L}}\p{{N}}])|(?<=\.)({_SURNAME})(?![\p{{L}}\p{{N}}])")
_REST = re.compile(rf"(?:{_GAP}{_INITIALS})?")
#: Read backwards from an anchor, so that a surname of any length is found without a window.
_AHEAD = re.compile(rf"(?r)(?<![\p{{L}}\p{{N}}'’.-])({_SURNAME})(,?){_GAP}")
#: A letter after a number, a degree sign or the like is a unit, and in brackets or after a section word no initial.
_SECOND = re.compile(r"\p{Lu}\.[^\S\r\n](?=\p{Lu})")
_NO_INITIAL = re.compile(r"(?r)(?:[\d%°º@²³⁻⁰-⁹][^\S\n]?|[\d.] ?[-–] ?)")


@lru_cache(200_000)
def plain(word: str) -> str:
    """Lower case without accents."""
    word = word.lower()
    if word.isascii():
        return word
    word = word.translate(str.maketrans("øłđßæœ", "oldsao"))
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


_PARTS, _NO_DIGIT = re.compile(r"[\s-]+"), re.compile(r"\D+")
_ORDINARY = frozenset(_listed(ORDINARY))
_PARTICLES = frozenset(PARTICLES[3:-1].split("|"))


@dataclass(frozen=True)
class People:
    """Given names and the words of surnames, both plain."""

    given: frozenset[str]
    surnames: frozenset[str]

    def surname_vote(self, surname: str) -> int:
        """1: every word is one of a known surname; -1: a word of the language; 0: unknown."""
        words = [plain(w) for w in _PARTS.split(surname)]
        words = [w for w in words if w not in _PARTICLES] or words
        if any(w in _ORDINARY for w in words):
            return -1
        return 1 if all(w in self.surnames for w in words) else 0


def known_names(people: DataFrame, given: str = "given_name", surname: str = "surname") -> DataFrame:
    """(w, is_given): every given name (first word) and every word of a surname of a table of people, plain; written once."""
    first = F.array(F.struct(F.lower(F.regexp_extract(F.col(given), r"^\p{L}+(?:-\p{L}+)*(?=\s|$)", 0)).alias("w"), F.lit(True).alias("is_given")))
    last = F.transform(F.split(F.lower(F.col(surname)), r"[\s-]+"), lambda x: F.struct(x.alias("w"), F.lit(False).alias("is_given")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([plain(w) for w in batch.column(0).to_pylist()], pa.string()), batch.column(1)], ["w", "is_given"])

    words = people.select(F.inline(F.concat(first, F.coalesce(last, F.array().cast("array<struct<w:string,is_given:boolean>>")))))
    words = words.where((F.length("w") > 1) & (F.col("is_given") | ~F.col("w").isin(*sorted(_PARTICLES))))
    return materialise(words.distinct().mapInArrow(run, "w string, is_given boolean").distinct(), "pii-names")


def gazetteer(people: DataFrame, given: str = "given_name", surname: str = "surname") -> People:
    """Given names and surname words of a table of people, in memory: for tables with up to GAZETTEER names."""
    known, names = split_gazetteer(people, given, surname)
    if names is not None:
        raise ValueError(f"more than {GAZETTEER} names: use split_gazetteer and with_names")
    return known


def split_gazetteer(people: DataFrame, given: str = "given_name", surname: str = "surname") -> tuple[People, DataFrame | None]:
    """The names of a table of people, and the table of names where it is too large to broadcast: then ``People`` is empty."""
    names = known_names(people, given, surname)
    if names.count() > GAZETTEER:
        return People(frozenset(), frozenset()), names
    rows = names.collect()
    return People(frozenset(r["w"] for r in rows if r["is_given"]), frozenset(r["w"] for r in rows if not r["is_given"])), None


def looked_up(text: str) -> set[str]:
    """Every word of a text that may be looked for among the names."""
    return {plain(w) for w in {*_TOKEN.findall(text), *_NAME.findall(text), *_WHOLE.findall(text)}}


def with_names(docs: DataFrame, names: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``given`` and ``surnames``: the known names among the capitalised tokens of the text.

    Tokens are joined with the names by shuffle; equal texts are looked up once, under a hash of the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = sorted(looked_up(t))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(words), pa.string()), pa.array(words, pa.string())], ["__text", "w"])

    keyed = docs.withColumn("__text", F.sha2(text, 256))
    tokens = spread(keyed.where(F.col(text).isNotNull()).select("__text", text)).mapInArrow(run, "__text string, w string").distinct()
    kinds = names.groupBy("w").agg(F.max(F.col("is_given")).alias("as_given"), F.max(~F.col("is_given")).alias("as_surname"))
    met = skew_join(materialise(tokens, "pii-tokens"), kinds, "w").groupBy("__text")
    found = met.agg(F.collect_list(F.when(F.col("as_given"), F.col("w"))).alias("given"), F.collect_list(F.when(F.col("as_surname"), F.col("w"))).alias("surnames"))
    return keyed.join(found, "__text", "left").drop("__text")


def _person_spans(text: str, people: People) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, form, surname) of names around a known given name or initials."""
    given = people.given
    if any(plain(w) in given for w in set(_TOKEN.findall(text))):
        for t in _TOKEN.finditer(text):
            if plain(t.group()) not in given:
                continue
            a, b = t.span()
            rival = False
            if m := _THEN.match(text, b):
                yield a, m.end(), "given first", m.group(1) or m.group(2)
                rival = plain(m.group(1) or m.group(2)) not in _ORDINARY
            if (m := _AHEAD.match(text, 0, a)) and plain(m.group(1)) not in given and plain(m.group(1)) not in _ORDINARY:
                yield m.start(1), _REST.match(text, b).end(), f"given {'comma' if m.group(2) else 'between' if rival else 'last'}", m.group(1)
    for t in _INIT.finditer(text):
        a, b = t.span()
        unit = " unit" if _NO_INITIAL.match(text, 0, a) else ""
        if unit and (m := _SECOND.match(text, a, b)):
            a, unit = m.end(), ""
        if m := _THEN.match(text, b):
            yield a, m.end(), f"initials first{unit}", m.group(1) or m.group(2)
        if not unit and (m := _AHEAD.match(text, 0, a)) and plain(m.group(1)) not in given and plain(m.group(1)) not in _ORDINARY:
            yield m.start(1), b, f"initials {'comma' if m.group(2) else 'last'}", m.group(1)


def _number_spans(text: str, low: str) -> Iterator[tuple[int, int, int, str]]:
    """(kind, start, end, form) of telephone and identity numbers."""
    end, zones = -1, []
    for m in _RUN.finditer(text):
        if sum(c.isdigit() for c in m.group()) < 6:
            continue
        a, b = max(m.start() - 5, end, 0), m.end()
        if a < end + 1 and zones:
            zones[-1][1] = b
        else:
            zones.append([a, b])
        end = b
    for za, zb in zones:
        for kind, patterns in ((1, _PHONE), (2, _ID)):
            taken: list[tuple[int, int]] = []  # spans of the known forms in this zone
            for form, p in patterns.items():
                known, at, top = form not in ("odd", "labelled"), 0, 0
                if not known:
                    taken.sort()
                found = []
                for m in p.finditer(text, za, zb + 12):
                    a, b = m.span()
                    if b > zb + 3:
                        continue
                    if not known:  # both are in order: none of the known spans may overlap
                        while at < len(taken) and taken[at][0] < b:
                            top, at = max(top, taken[at][1]), at + 1
                        if top > a:
                            continue
                        if form == "labelled":
                            n = sum(c.isdigit() for c in m.group())
                            if not (7 if kind == 1 else 6) <= n <= 15 or _label(KINDS[kind], text[max(0, a - BEFORE) : a]) != 1:
                                continue
                    if form != "odd":
                        found.append((a, b))
                    yield kind, a, b, form
                taken += found
    if "pas" in low or "ausweis" in low or "identity" in low or "licen" in low or "dni" in low or "insurance" in low or " id" in low:
        for m in _CODE.finditer(text):
            yield 2, m.start(1), m.end(1), "labelled"


def _email_spans(text: str, low: str) -> Iterator[tuple[int, int, str]]:
    forms = [("plain", "@" in text), ("written", ("(" in low or "[" in low or "{" in low) and _BRACKET_AT.search(low)), ("spoken", "dot" in low and " at" in low), ("odd", "@" in text)]
    taken: list[tuple[int, int]] = []
    for form, worth in forms:
        if not worth:
            continue
        at = 0
        for m in _EMAIL[form].finditer(text):
            a, b = m.span()
            if form == "odd":
                while at < len(taken) and taken[at][1] <= a:
                    at += 1
                if at < len(taken) and taken[at][0] < b:
                    continue
            yield a, b, form
        if form != "odd":
            taken = sorted(taken + [m.span() for m in _EMAIL[form].finditer(text)])


def _address_spans(text: str, low: str) -> Iterator[tuple[int, int, str]]:
    taken: list[tuple[int, int]] = []
    for form, p in _ADDRESS.items():
        if form in _NEEDS and not _NEEDS[form](low):
            continue
        at = 0
        for m in p.finditer(text):
            a, b = m.span()
            if form == "odd":
                while at < len(taken) and taken[at][1] <= a:
                    at += 1
                if at < len(taken) and taken[at][0] < b:
                    continue
            else:
                taken.append((a, b))
            yield a, b, form
        if form == "spanish":
            taken.sort()


def propose(text: str, people: People) -> list[tuple[int, int, int, str, str]]:
    """(kind, start, end, form, surname) of all candidates; of the same kind, start and end, the first pattern counts."""
    low = text.lower()
    out: dict[tuple[int, int, int], tuple[str, str]] = {}
    for a, b, form in _email_spans(text, low):
        out.setdefault((0, a, b), (form, ""))
    for kind, a, b, form in _number_spans(text, low):
        out.setdefault((kind, a, b), (form, ""))
    for a, b, form in _address_spans(text, low):
        out.setdefault((3, a, b), (form, ""))
    for a, b, form, surname in _person_spans(text, people):
        out.setdefault((4, a, b), (form, surname))
    return [(k, a, b, *v) for (k, a, b), v in out.items()]


# --- labelers

_ANNOUNCED = {kind: frozenset(_listed(words)) for kind, words in ANNOUNCED.items()}
_THINGS, _UNITS, _EPONYMS = frozenset(_listed(THINGS)), frozenset(_listed(UNITS)), frozenset(_listed(EPONYMS))
#: How many words back a label may stand.
REACH = {"email": 4, "phone": 5, "id_number": 5, "address": 4, "person": 2}
_PIECES = re.compile(r"\p{L}+|\p{N}+|\n\s*\n|[.!?](?=\s+\p{Lu}\p{Ll})")
_FIRST = re.compile(r"\p{L}+")


def _label(kind: str, before: str) -> int:
    """The nearest label before a span: 1 of this kind, -1 of another or of a thing, 0 none in reach.

    A label of another kind that has its number already says nothing; one of a thing goes on through a list.
    """
    words = _PIECES.findall(before)
    own, numbers, seen = _ANNOUNCED[kind], 0, 0
    for i in range(len(words) - 1, -1, -1):
        w = words[i]
        if w[0] in ".!?\n":
            if w[0] != "." or i == 0 or plain(words[i - 1]) not in own:
                return 0
            continue
        if w[0].isdigit():
            numbers += 1
            continue
        w = plain(w)
        two = f"{plain(words[i - 1])} {w}" if i else w
        if w in own or two in own:
            return 1 if numbers == 0 or kind in ("address", "person") else 0
        if kind not in ("email", "person") and (w in _THINGS or two in _THINGS):
            return -1
        if not numbers and kind in ("phone", "id_number") and w in _ANNOUNCED["id_number" if kind == "phone" else "phone"]:
            return -1
        seen += 1
        if seen >= REACH[kind]:
            break
    return 0


_CLOSES = re.compile(r"\s*(?:$|[)>;·/,]|[.!?](?:\s|$)|[^\S\n]*\n)")
_MORE = re.compile(r"[,;]?\s*(?:\(?ext|\(?home|\(?work|\(?mobile|durchwahl|poste|or\b)", re.I)
_LOCALITY = re.compile(r",?\s+(?:\d{4,5}\b|\p{Lu}\p{Ll}+)|\s*[,/]")


def _after(kind: str, after: str) -> int:
    """What follows a span: 1 it closes as such data do, -1 a unit, a plot, further signs; 0 plain text."""
    if after[:1].isalnum() or after[:1] == "@":
        return -1
    m = _FIRST.match(after, 1) if after[:1] in " \xa0" else None
    word = plain(m.group()) if m else ""
    if kind == "person":
        if word in _EPONYMS or after.startswith(("–", "-")):
            return -1
    elif kind == "address":
        if word in _EPONYMS or word == "of":
            return -1
        if _LOCALITY.match(after):
            return 1
    elif word in _UNITS or after[:1] == "%" or (len(word) == 1 and word not in "aioyeu"):
        return -1
    elif _MORE.match(after):
        return 1
    return 1 if _CLOSES.match(after) else 0


#: Public country calling codes.
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 234 254 351 352 353 354 355 356 357 358 359 370 371 372 380 381 385 386 420 421 852 853 886 961 962 965 966 971 972 974 977".split())


def _plan(form: str, run: str) -> int:
    """Whether a telephone number fits a public numbering plan: a known country code and length, a trunk number, or area and exchange of North America."""
    digits = _NO_DIGIT.sub("", run)
    if form in ("plus", "zeros"):
        digits = digits[2:] if form == "zeros" else digits
        return 1 if 9 <= len(digits) <= 15 and any(digits[:k] in CALLING_CODES for k in (1, 2, 3)) else -1
    if form in ("three", "area"):
        return 1 if digits[0] > "1" and digits[3] > "1" and digits[1:3] != "11" and digits[4:6] != "11" else -1
    if form in ("trunk", "bracket", "pairs", "hyphen"):
        return 1 if 8 <= len(digits) <= 12 else -1
    return 0 if form == "labelled" else -1


def _shape(kind: int, form: str) -> int:
    """How telling a form is by itself."""
    if form == "odd" or form.endswith("unit"):
        return -1
    if kind in (1, 2):
        return 0 if form in ("three", "labelled", "insurance", "pass") else 1
    return 0 if form in ("spoken", "given between") or form.startswith("initials") else 1


def _gazetteer_vote(kind: int, run: str, form: str, surname: str, people: People) -> int:
    if kind == 4:
        return people.surname_vote(surname)
    if kind == 1:
        return _plan(form, run)
    if kind == 2:
        digits = _NO_DIGIT.sub("", run)
        if form == "three":  # public rule of social security numbers, those for taxes with it
            return -1 if digits[:3] in ("000", "666") or digits[3:5] == "00" or digits[5:] == "0000" else 0
        if form == "birth":
            return 1 if 1 <= int(digits[:2]) <= 31 and 1 <= int(digits[2:4]) <= 12 else -1
        return -1 if form == "odd" else 0
    if kind == 3:
        return 1 if any(c.isdigit() for c in run) and form != "odd" else -1
    return -1 if form == "odd" else 1


_FIRST_WORDS = re.compile(r"\W*(\p{L}+)?")


def _context(kind: int, form: str, before: str, after: str) -> list[int]:
    """Hashed features: the pattern's form and the words on either side."""
    words = _FIRST.findall(before[-32:])
    l1, l2 = words[-1].lower() if words else "", words[-2].lower() if len(words) > 1 else ""
    r1 = (_FIRST_WORDS.match(after).group(1) or "").lower()
    marks = (f"f={form}", f"l={l1}", f"ll={l2} {l1}", f"r={r1}", f"p={before.rstrip()[-1:]}", f"q={after.lstrip()[:1]}")
    return sorted({zlib.crc32(f"{kind} {m}".encode()) % CONTEXT for m in marks})


def spans_of(text: str | None, people: People) -> list[dict]:
    """Candidates of a text with their votes and context."""
    if not text:
        return []
    found = propose(text, people)
    if not found:
        return []
    found.sort(key=lambda x: (x[1], x[2], x[0]))
    strong = [(k, a, b) for k, a, b, form, surname in found if _shape(k, form) == 1 or (surname and people.surname_vote(surname) == 1)]
    out, lo = [], 0
    for kind, a, b, form, surname in found:
        name, before, after = KINDS[kind], text[max(0, a - BEFORE) : a], text[b : b + AFTER]
        while lo < len(strong) and strong[lo][1] < a - 200:
            lo += 1
        near = 0
        at = lo
        while at < len(strong) and strong[at][1] <= b + 80:
            k, x, y = strong[at]
            at += 1
            if k != kind and y > a - 80 and (y <= a or x >= b):
                near = 1
                break
        votes = (_shape(kind, form), _gazetteer_vote(kind, text[a:b], form, surname, people), _label(name, before), _after(name, after), near)
        out.append({"kind": kind, "a": a, "b": b, "run": text[a:b], "votes": "".join("-0+"[v + 1] for v in votes), "ctx": _context(kind, form, before, after)})
    return out


# --- reliabilities and classifier, on the driver from bounded tables


#: Where the estimation starts: shares of the votes -, 0, + on other text and on personal data. It weighs as much as
#: WEIGHT candidates a class, so that the counts of any larger corpus outweigh it.
BELIEF = {
    "shape": ((0.50, 0.25, 0.25), (0.05, 0.25, 0.70)),
    "gazetteer": ((0.45, 0.35, 0.20), (0.05, 0.35, 0.60)),
    "before": ((0.45, 0.50, 0.05), (0.02, 0.38, 0.60)),
    "after": ((0.35, 0.45, 0.20), (0.05, 0.45, 0.50)),
    "near": ((0.00, 0.75, 0.25), (0.00, 0.45, 0.55)),
}
WEIGHT = 100
PULL = 1e-3


def fit_reliability(patterns: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], np.ndarray]:
    """Probability of each vote pattern by expectation-maximisation over the counts of all candidates, and the log odds
    that the reliabilities give to each vote, as weights of a classifier.

    It starts from BELIEF, so that the second class is the personal data, and is then led by the counts.
    """
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    votes = np.array([["-0+".index(c) for c in k] for k in keys])
    belief = np.clip(np.array([[BELIEF[name][c] for name in LABELERS] for c in (0, 1)]), 1e-3, 1)
    table, prior, p = belief.copy(), 0.5, np.full(len(keys), 0.5)
    for _ in range(rounds):
        like = np.array([[np.log(table[c, range(len(LABELERS)), v]).sum() for v in votes] for c in (0, 1)])
        p = 1 / (1 + np.exp(np.clip(like[0] + np.log1p(-prior) - like[1] - np.log(prior), -60, 60)))
        prior = float(np.clip((n @ p + 1) / (n.sum() + 2), 0.02, 0.98))
        for c, w in ((0, n * (1 - p)), (1, n * p)):
            for j in range(len(LABELERS)):
                seen = np.bincount(votes[:, j], weights=w, minlength=3)
                table[c, j] = (seen + WEIGHT * belief[c, j]) / (seen.sum() + WEIGHT)
    weights = np.zeros(SIZE, np.float32)
    weights[: 1 + 3 * len(LABELERS)] = [np.log(prior / (1 - prior)), *np.log(table[1] / table[0]).ravel()]
    return dict(zip(keys, p.tolist(), strict=True)), weights


#: Features of a span: one of three for each vote, and its context.
SIZE = 1 + 3 * len(LABELERS) + CONTEXT


def features(votes: str, ctx: list[int]) -> list[int]:
    """Places of the ones in a span's features."""
    return [0, *(1 + 3 * j + "-0+".index(v) for j, v in enumerate(votes)), *(1 + 3 * len(LABELERS) + k for k in ctx)]


def fit_classifier(votes: list[str], ctx: list[list[int]], target: list[float], start: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights of a logistic model of the probabilities, by gradient steps with momentum from the labelers' log odds.

    It is drawn back to them (PULL), so that votes keep their meaning where the sample says little. Equal spans are one
    row with a weight.
    """
    rows: dict[tuple, list[float]] = {}
    for v, c, t in zip(votes, ctx, target, strict=True):
        got = rows.setdefault(tuple(features(v, c)), [0.0, 0.0])
        got[0] += 1
        got[1] += t
    n = np.array([r[0] for r in rows.values()], np.float32)
    y = np.array([r[1] for r in rows.values()], np.float32) / n
    x = np.zeros((len(rows), SIZE), np.float32)
    for i, at in enumerate(rows):
        x[i, list(at)] = 1
    w, step, total = start.copy(), np.zeros(SIZE, np.float32), n.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = 0.9 * step - 0.3 * (x.T @ (n * (p - y)) / total + PULL * (w - start))
        w = w + step
    return w


@dataclass
class PiiModel:
    """The gazetteer, the classifier's weights by kind, and on the driver the table of names where it is not broadcast."""

    people: People
    weights: dict[int, np.ndarray]
    names: DataFrame | None = None

    def __post_init__(self) -> None:
        self.plain_weights = {k: w.tolist() for k, w in self.weights.items()}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"names": None}

    def score(self, span: dict) -> float:
        """The classifier's log odds of a span; negative for a kind that was never fitted."""
        w = self.plain_weights.get(span["kind"])
        return sum(w[k] for k in features(span["votes"], span["ctx"])) if w else -1.0

    def choose(self, spans: list[dict]) -> list[dict]:
        """The spans taken as personal data, without overlaps: the set with the largest sum of scores, then the longer."""
        scored = [(v, s) for s in spans if (v := self.score(s)) > 0]
        if len(scored) < 2:
            return [s for _, s in scored]
        scored.sort(key=lambda x: (x[1]["b"], x[1]["a"], x[1]["kind"]))
        ends = [s["b"] for _, s in scored]
        best, back = [0.0], []
        for i, (v, s) in enumerate(scored):
            at = bisect_right(ends, s["a"], 0, i)
            gain = best[at] + min(v, 2.0) + 0.05 * (s["b"] - s["a"])
            back.append(at if gain > best[i] else -1)
            best.append(max(gain, best[i]))
        taken, i = [], len(scored)
        while i:
            if back[i - 1] < 0:
                i -= 1
            else:
                taken.append(scored[i - 1][1])
                i = back[i - 1]
        return taken[::-1]


def _people_of(people: People, batch: pa.RecordBatch) -> Iterator[People]:
    """The people to use for each document: with its own names where the batch has them as further columns."""
    if batch.num_columns < 3:
        yield from (people for _ in range(batch.num_rows))
    else:
        yield from (People(frozenset(g or ()), frozenset(n or ())) for g, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))


def candidate_spans(docs: DataFrame, people: People, key: str = "doc_id", text: str = "text", names: DataFrame | None = None, keep_text: bool = False) -> DataFrame:
    """(key, spans): the candidates of every document that has some. ``names``: a table of names too large to broadcast.

    ``keep_text``: (key, text, spans) of all documents, to be masked without a second search.
    """
    known = docs.sparkSession.sparkContext.broadcast(people)  # bounded by GAZETTEER
    kind = pa.struct([("kind", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("run", pa.string()), ("votes", pa.string()), ("ctx", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [spans_of(t.as_py(), p) for t, p in zip(batch.column(1), _people_of(known.value, batch), strict=True)]
            found = pa.array(spans, pa.list_(kind))
            if keep_text:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], [key, text, "spans"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), found], [key, "spans"]).filter(pa.array([bool(s) for s in spans]))

    own = docs.select(key, text)
    kept = f"`{text}` string, " if keep_text else ""
    return spread(own if names is None else with_names(own, names, text)).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {kept}spans {SPANS}")


def train(spans: DataFrame, people: People, key: str = "doc_id") -> PiiModel:
    """Reliabilities from the vote counts of all candidates, classifiers from a bounded sample of spans."""
    flat = spans.select(key, F.explode("spans").alias("s")).select(key, "s.*")
    counts: dict[int, dict[str, int]] = {}
    for r in flat.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect():  # at most 3 ** 5 patterns a kind
        counts.setdefault(r["kind"], {})[r["votes"]] = r["n"]
    share = F.lit(0.0)
    for k, c in counts.items():
        share = F.when(F.col("kind") == k, min(1.0, FIT_SPANS / sum(c.values()))).otherwise(share)
    dice = F.pmod(F.xxhash64(key, "a", "kind"), F.lit(1 << 20)) / float(1 << 20)
    sample = flat.where(dice < share).select("kind", "votes", "ctx").toPandas()
    weights = {}
    for k, c in counts.items():
        truth, start = fit_reliability(c)
        own = sample[sample["kind"] == k]
        if len(own):
            votes = own["votes"].tolist()
            weights[k] = fit_classifier(votes, [list(x) for x in own["ctx"]], [truth[v] for v in votes], start)
    return PiiModel(people, weights)


def fit(docs: DataFrame, people: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = False) -> tuple[PiiModel, DataFrame]:
    """The model, and the candidates it was fitted on (written once: texts are searched a single time)."""
    known, names = split_gazetteer(people)
    spans = materialise(candidate_spans(docs, known, key, text, names, keep_text), "pii-spans")
    return replace(train(spans, known, key), names=names), spans


def found_spans(model: PiiModel, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pii_kind, pii_text): each distinct run and kind of a document."""
    known = spans.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds, runs = [], [], []
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for kind, text in dict.fromkeys((x["kind"], x["run"]) for x in known.value.choose(s.as_py())):
                    ids.append(i)
                    kinds.append(KINDS[kind])
                    runs.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(kinds, pa.string()), pa.array(runs, pa.string())], [key, "pii_kind", "pii_text"])

    return spans.mapInArrow(run, f"`{key}` {spans.schema[key].dataType.simpleString()}, pii_kind string, pii_text string").distinct()


@cache
def placeholder(kind: int) -> str:
    """What stands in place of a kind."""
    return f"[{KINDS[kind].upper()}]"


def masked_text(text: str | None, spans: list[dict]) -> str | None:
    """The text with placeholders for disjoint spans in order."""
    if not spans:
        return text
    parts, at = [], 0
    for s in spans:
        parts += [text[at : s["a"]], placeholder(s["kind"])]
        at = s["b"]
    return "".join([*parts, text[at:]])


def mask_spans(spans: DataFrame, model: PiiModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with placeholders, from candidates kept with their text: nothing is searched again."""
    known = spans.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [masked_text(t, known.value.choose(s)) if s else t for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [key, text])

    return spans.select(key, text, "spans").mapInArrow(run, f"`{key}` {spans.schema[key].dataType.simpleString()}, `{text}` string")


def mask(docs: DataFrame, model: PiiModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) of every document with placeholders in place of personal data."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(1).to_pylist(), _people_of(known.value.people, batch), strict=True)
            out = [masked_text(t, known.value.choose(spans_of(t, p))) for t, p in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [key, text])

    own = docs.select(key, text)
    return spread(own if model.names is None else with_names(own, model.names, text)).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, `{text}` string")
