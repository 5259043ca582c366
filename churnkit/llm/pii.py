"""Replacement of personal data by keyed, type-consistent surrogates.

1. *Detect*: e-mail addresses, phone numbers, IPv4 and IPv6 addresses, payment cards (Luhn), IBANs (mod 97),
   US social security numbers, secrets (long hexadecimal, well-known key prefixes, assigned tokens, passwords in URLs),
   person names behind one or more titles and further mentions of these names in the same text.
2. *Assign*: an entity's canonical form (case, separators and formatting removed) and a secret key
   determine its surrogate, so all its mentions, in every document and format, get the same one.
   Surrogates keep kind, script, letter case, digit places, separators, checksums and, for names of
   several words, the gender that the titles of all mentions in the corpus tell (neutral if none or both).
3. *Check*: over all distinct entities of the corpus, two that share a surrogate, or one
   whose surrogate is itself an entity, are found by aggregates; all but the first
   draw again (a further attempt enters the key) until none is left.  The domain grows with the
   attempt (more syllables, letters or digits; freed octets), so small ones cannot run out.
4. *Apply*: texts are rewritten in one map.  Only entities on a further attempt, or whose gender
   differs between texts, need to be told; up to ``broadcast_rows`` of them go to every task, more
   are joined to their rows.

Edge cases: null texts stay null, empty ones empty; overlapping finds go to the one that
starts first, then the longer; repeated rows are rewritten alike; very long texts are
scanned whole; empty tables give no rows; all other columns are kept.
"""

from __future__ import annotations

import hashlib
import ipaddress
import itertools
import re
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, content_key, keeping_columns, text_of, written

#: titles that tell a gender, and given names by gender and script for surrogates (fixed values)
TITLES = {
    "m": ("Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Sra", "Doña", "Госпожа", "Κυρία"),
    "n": ("Dr", "Prof", "Professor"),
}
GIVEN = {
    ("latin", "m"): ("Adam", "Brian", "Carl", "Daniel", "Edgar", "Felix", "George", "Hugo", "Ivan", "Jonas", "Karl", "Louis", "Martin", "Nils", "Oscar", "Paul", "Robert", "Simon", "Thomas", "Victor"),
    ("latin", "f"): ("Alice", "Bianca", "Clara", "Diana", "Elena", "Flora", "Greta", "Helen", "Irene", "Julia", "Karen", "Laura", "Maria", "Nina", "Olga", "Paula", "Rosa", "Sofia", "Teresa", "Vera"),
    ("latin", "n"): ("Alex", "Andrea", "Chris", "Dominique", "Jamie", "Kim", "Robin", "Sam", "Sascha", "Toni"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Максим", "Павел"),
    ("cyrillic", "f"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья"),
    ("cyrillic", "n"): ("Саша", "Женя", "Валя", "Шура"),
    ("greek", "m"): ("Ανδρέας", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"),
    ("greek", "f"): ("Άννα", "Ελένη", "Ειρήνη", "Κατερίνα", "Μαρία", "Σοφία"),
    ("greek", "n"): ("Άρης", "Εύα"),
}
SYLLABLES = {
    "latin": ("ba", "cor", "del", "fen", "gar", "hol", "kin", "lam", "mor", "nel", "per", "ros", "sel", "tan", "ver", "wil"),
    "cyrillic": ("ба", "вер", "гор", "дан", "жел", "зор", "кор", "лав", "мир", "нов", "пет", "ров", "сол", "тор", "фед", "чер"),
    "greek": ("βα", "γερ", "δημ", "θεο", "καρ", "λαμ", "μαν", "νικ", "παπ", "ραλ", "σαβ", "ταν", "φιλ", "χρι", "ψαρ", "ζαχ"),
}
_UP, _LOW = "[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁΆ-Ώ]", "[a-zà-öø-ÿßα-ωά-ώа-яё]"
# McDonald, O'Brien, SMITH, Smith-Jones
_PART = rf"(?:{_UP}['’](?={_UP}))?{_UP}(?:{_LOW}+(?:{_UP}{_LOW}+)*|{_UP}+(?!{_LOW}))"
_CAP = rf"{_PART}(?:[-'’]{_PART})?"
#: titles that count in capitals too; others are common words
_CAPITALS = {t.upper(): t for t in ("Mr", "Mrs", "Dr", "Prof", "Herr", "Frau")}
_TITLES = [*(t for ts in TITLES.values() for t in ts), *_CAPITALS]
_TITLE = "|".join(sorted(_TITLES, key=len, reverse=True))
_ASSIGN = r"(?i:(?<![A-Za-z0-9])(?:token|secret|passwd|password|api_?key)[\"']?\s*[=:]\s*)"
_ENDS = r"\s\"'=:,;&(){}\[\]<>"
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,24}",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])",
    "key": r"(?<![A-Za-z0-9])(?:[spr]k[-_][A-Za-z0-9_\-]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|xox[abprs]-[A-Za-z0-9\-]{10,})(?![A-Za-z0-9])",
    "assigned": rf"{_ASSIGN}[\"'](?P<value>[^\s\"']{{8,}})(?=[\"'])",
    # without quotes: directly behind =, or with a digit
    "bare": rf"{_ASSIGN}(?:(?<==)|(?=[^{_ENDS}]*\d))(?P<value>[^{_ENDS}]{{8,}}+=*+)(?![(\[{{<\"'])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ \-])\d{6}\2\d{5})(?!\d)",
    "ssn": r"(?<![\d\-])(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d\-])",
    "login": r"(?<=://)[^\s/:@]+:(?P<value>[^\s/@]+)(?=@)",
    "ip6": r"(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9A-Fa-f]{3})(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[.\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?!\d)",
    "name": rf"(?<!\w)(?P<title>(?:(?:{_TITLE})\.?[ \t]+){{1,6}})(?P<person>(?!(?:{_TITLE})\b){_CAP}(?:[ \t\xa0]+{_CAP}){{0,2}})",
}
_FIND = {k: re.compile(p) for k, p in _PATTERNS.items()}
_GENDER = {t: g for g in "mf" for t in TITLES[g]}
_GENDER |= {up: _GENDER[t] for up, t in _CAPITALS.items() if t in _GENDER}
_RUN = re.compile(rf"(?<!\w){_CAP}(?!\w)(?:\s+{_CAP}(?!\w))*")
_KEY_WORD = re.compile(r"(?i)token|secret|passw|api_?key")
#: a pattern is tried only on texts that hold what every match of it holds
_NEEDS = {
    "email": lambda t, d: "@" in t,
    **dict.fromkeys(("assigned", "bare"), lambda t, d: ("=" in t or ":" in t) and _KEY_WORD.search(t) is not None),
    "login": lambda t, d: "://" in t and "@" in t,
    "ip6": lambda t, d: t.count(":") > 1,
    "key": lambda t, d: "_" in t or "AKIA" in t or any(x in t for x in ("sk-", "pk-", "rk-", "xox")),
    "name": lambda t, d: any(x in t for x in _TITLES),
    # 32 hexadecimal characters without a decimal digit do not occur by chance
    **dict.fromkeys(("secret", "iban", "card", "ssn", "ip", "phone"), lambda t, d: d),
}
_DIGIT = re.compile(r"\d")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_rest(value: str) -> int:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


def canonical(kind: str, mention: str) -> str:
    if kind in ("card", "ssn", "phone"):
        digits = re.sub(r"\D", "", mention)
        return "+" * mention.startswith("+") + digits if kind == "phone" else digits
    if kind == "iban":
        return mention.replace(" ", "")
    if kind in ("email", "secret"):
        return mention.lower() if kind == "email" or re.fullmatch("[0-9A-Fa-f]+", mention) else mention
    if kind == "ip":
        return ".".join(str(int(x)) for x in mention.split("."))
    if kind == "ip6":
        try:
            return str(ipaddress.IPv6Address(mention))
        except ValueError:
            return ""
    if kind == "name":  # in capitals or not, whatever the spaces
        return " ".join(w[0] + w[1:].lower() if w.isupper() else w for w in mention.split())
    return mention


def valid(kind: str, key: str) -> bool:
    if kind == "card":
        return 13 <= len(key) <= 19 and luhn(key)
    if kind == "iban":
        return iban_rest(key) == 1
    if kind == "ip6":
        return key != ""
    return kind != "phone" or 7 <= len(key.lstrip("+")) <= 15


def mentions_of(text: str, names: set[str]) -> list[tuple[int, int, str]]:
    """(start, end, name) of the runs of capitalised words that are one of ``names``; longest first, apart."""
    out = []
    longest = max(n.count(" ") for n in names) + 1
    for run in _RUN.finditer(text):
        words = [(run.start() + w.start(), run.start() + w.end()) for w in re.finditer(r"\S+", run[0])]
        i = 0
        while i < len(words):
            for k in range(min(longest, len(words) - i), 0, -1):
                a, b = words[i][0], words[i + k - 1][1]
                name = canonical("name", text[a:b])
                if name in names and (k > 1 or not text[a:b].isupper()):
                    out.append((a, b, name))
                    break
            else:
                k = 1
            i += k
    return out


def detect(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, canonical form, genders that titles in the text tell) of the entities, in order and apart."""
    found, told = [], {}
    digits = _DIGIT.search(text) is not None
    for kind, pattern in _FIND.items():
        if not _NEEDS[kind](text, digits):
            continue
        group = {"assigned": "value", "bare": "value", "login": "value", "name": "person"}.get(kind, 0)
        kind = "secret" if kind in ("key", "assigned", "bare", "login") else kind
        m = pattern.search(text)
        while m:
            a, b = m.span(group)
            key = canonical(kind, m[group])
            if valid(kind, key):
                if kind == "name":
                    told.setdefault(key, set()).update(_GENDER[t] for t in re.split(r"[.\s]+", m["title"]) if t in _GENDER and " " in key)
                found.append((a, -b, kind, key))
                m = pattern.search(text, m.end())
            else:  # another match may begin within this one
                m = pattern.search(text, m.start() + 1)
    if told:
        found += [(a, -b, "name", key) for a, b, key in mentions_of(text, told.keys())]
    out, end = [], 0
    for a, b, kind, key in sorted(found):
        if a >= end:
            out.append((a, -b, kind, key, "".join(sorted(told[key])) if kind == "name" else ""))
            end = -b
    return out


class Stream:
    """Numbers below a bound, drawn from a keyed hash of (kind, canonical form, attempt)."""

    def __init__(self, secret: bytes, *what):
        self.secret, self.what, self.block, self.value, self.left = secret, "\0".join(map(str, what)).encode("utf-8", "surrogatepass"), 0, 0, 1

    def below(self, n: int) -> int:
        if self.left < n << 32:
            d = hashlib.blake2b(self.what + self.block.to_bytes(4, "big"), key=self.secret, digest_size=64).digest()
            self.value, self.left, self.block = int.from_bytes(d, "big"), 1 << 512, self.block + 1
        self.value, r = divmod(self.value, n)
        self.left //= n
        return r


def _script(s: str) -> str:
    c = next((c for c in s if c.isalpha()), "a")
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


@lru_cache(maxsize=20_000)
def surrogate(kind: str, key: str, gender: str, attempt: int, secret: bytes) -> str:
    """Canonical form of the surrogate; never the entity itself."""
    for level in itertools.count(attempt):
        r = Stream(secret, kind, key, attempt * 1000 + level - attempt)
        if kind == "name":
            script = _script(key)
            given = GIVEN[script, gender if gender in ("m", "f") else "n"]
            parts = [given[r.below(len(given))]] if " " in key else []
            while len(parts) < max(1, key.count(" ") + 1):
                family = "".join(SYLLABLES[script][r.below(16)] for _ in range(2 + level + r.below(2)))
                parts.append(family.capitalize())
            out = " ".join(parts)
        elif kind == "ip":
            out = _address(key, level, r)
        elif kind == "ip6":  # of the block set aside for documentation
            out = str(ipaddress.IPv6Address("2001:db8:" + ":".join(f"{r.below(1 << 16):x}" for _ in range(6))))
        elif kind == "email":
            local, _, host = key.partition("@")
            labels = host.split(".")
            keep = 2 if labels[-2] == "example" else 1
            new = [_like(x, r) for x in labels[:len(labels) - keep]] if keep == 2 else ["example"]
            out = _like(local, r) + _more(level - 1, r, 36) + "@" + ".".join(new + labels[len(labels) - keep:])
        elif kind == "iban":
            body = "".join(_like_char(c, r) if level < 6 else _ALNUM[r.below(36)].upper() for c in key[4:])
            out = f"{key[:2]}{98 - iban_rest(key[:2] + '00' + body):02d}{body}"
        elif kind == "card":
            body = key[0] + "".join(str(r.below(10)) for _ in key[1:-1])
            out = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        elif kind == "ssn":  # areas from 900 are never given out; the others follow when these run short
            area = 900 + r.below(100) if level < 6 else (1 + r.below(899))
            out = f"{area + (area == 666):03d}{1 + r.below(99):02d}{1 + r.below(9999):04d}"
        elif kind == "phone":
            sign, digits = ("+", key[1:]) if key[0] == "+" else ("", key)
            keep = 1 if digits[0] in "17" else 2  # the country code stays
            keep = keep if sign else 0
            out = sign + digits[:keep] + "".join(str(r.below(10)) for _ in digits[keep:]) + _more(min(level - 3, 15 - len(digits)), r, 10)
        elif re.fullmatch("[0-9a-f]+", key):
            out = "".join("0123456789abcdef"[r.below(16)] for _ in key) + _more(level - 4, r, 16)
        else:
            head = re.match(r"(?:[a-z]{2,4}[-_]|AKIA|xox[abprs]-)?", key)[0]
            out = head + "".join(_free_char(c, level, r) for c in key[len(head):]) + _more(level - 4, r, 62)
        if out != key and canonical(kind, out) == out:
            return out


_ALNUM = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _more(n: int, r: Stream, below: int) -> str:
    """``n`` further characters (none if negative) out of the first ``below`` of digits and letters."""
    return "".join(_ALNUM[r.below(below)] for _ in range(n))


def _free_char(c: str, level: int, r: Stream) -> str:
    """Like ``c``; letters without a like become digits or letters, from the first level on other signs too."""
    new = _like_char(c, r)
    if new == c and not re.match("[0-9A-Za-zа-яА-Я]", c) and (level or c.isalnum()):
        return _ALNUM[r.below(62)]
    return new


def _address(key: str, level: int, r: Stream) -> str:
    """An address of the same block and digit counts; from level 2 on the octets behind the block are free,
    from 6 on private ones come from 10.0.0.0/8 and others from every first octet, from 12 on all do."""
    old = list(map(int, key.split(".")))
    a, b = old[:2]
    private = a == 10 or (a, b) == (192, 168) or a == 172 and 16 <= b < 32
    if level >= 6:
        first = [x for x in range(1, 224) if x not in (10, 127, 169, 172, 192)]
        head = [10] if private and level < 12 else [first[r.below(len(first))]]
    elif private:
        head = [10] if a == 10 else [a, b]
    else:
        head = [1 + r.below(9) if a < 10 else 11 + r.below(89) if a < 100 else 128 + r.below(40) if a < 200 else 200 + r.below(24)]
    for x in old[len(head):]:  # as many digits as before
        lo, hi = (0, 256) if level >= 2 else (0, 10) if x < 10 else (10, 100) if x < 100 else (100, 256)
        head.append(lo + r.below(hi - lo))
    return ".".join(map(str, head))


def _like_char(c: str, r: Stream) -> str:
    for lo, n in (("0", 10), ("a", 26), ("A", 26), ("а", 32), ("А", 32)):
        if lo <= c < chr(ord(lo) + n):
            return chr(ord(lo) + r.below(n))
    return c


def _like(s: str, r: Stream) -> str:
    return "".join(_like_char(c, r) for c in s)


def in_format(kind: str, mention: str, value: str) -> str:
    """The surrogate's canonical form with the mention's separators and letter case."""
    if kind in ("card", "ssn", "phone", "iban"):
        it = iter(value.lstrip("+"))
        return "".join(next(it, "") if c.isalnum() else c for c in mention) + "".join(it)
    if kind == "email":
        local, at, host = mention.partition("@")
        new_local, _, new_host = value.partition("@")
        return _cased(local, new_local) + at + _cased(host, new_host)
    if kind == "name":
        it = iter(value.upper().split() if mention.isupper() else value.split())
        return re.sub(r"\S+", lambda _: next(it), mention)
    if kind == "secret" and mention.isupper() and re.fullmatch("[0-9A-F]+", mention):
        return value.upper()
    return value


def _cased(old: str, new: str) -> str:
    if old.isupper():
        return new.upper()
    return new if len(old) != len(new) else "".join(b.upper() if a.isupper() else b for a, b in zip(old, new))


def rewrite(text: str, told, secret: bytes) -> tuple[str, int, str]:
    """Text with surrogates, number of entities, and their kinds (sorted, comma separated).

    ``told`` has (attempt, gender) by (kind, canonical form) where they differ from what the text tells."""
    parts, pos, kinds = [], 0, set()
    found = detect(text)
    for a, b, kind, key, gender in found:
        attempt, gender = told.get((kind, key), (0, gender))
        value = surrogate(kind, key, gender, attempt, secret)
        parts += [text[pos:a], in_format(kind, text[a:b], value)]
        pos = b
        kinds.add(kind)
    return ("".join([*parts, text[pos:]]) if parts else text), len(found), ",".join(sorted(kinds))


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``kind, key, gender, mixed`` of each entity of the corpus: the genders that any title tells, and whether texts differ."""
    def run(it):
        for b in batches(it, 2048):
            found = {x[2:] for t in b.column(0).to_pylist() for x in detect(t)}
            kind, key, gender = zip(*found) if found else ([],) * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (kind, key, gender)], names=["kind", "key", "gender"])

    any_of = lambda g: F.when(F.max(F.col("gender").contains(g)), F.lit(g)).otherwise("")
    return (docs.select(text_of(docs, text_col)).mapInArrow(run, "kind string, key string, gender string").groupBy("kind", "key")
            .agg(F.concat(any_of("f"), any_of("m")).alias("gender"), (F.min("gender") != F.max("gender")).alias("mixed")))


def assign(found: DataFrame, secret: bytes) -> DataFrame:
    """``kind, key, gender, mixed, attempt, value`` with distinct values, none of which is an entity.

    Each round draws and writes only the entities that clashed in the one before."""
    @F.pandas_udf("string")
    def value(kind: pd.Series, key: pd.Series, gender: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(*x, secret) for x in zip(kind, key, gender, attempt)], dtype=object)

    cols = [*found.columns, "attempt", "value"]
    real = found.select("kind", F.col("key").alias("value"))
    settled: list[DataFrame] = []
    new = written(found.withColumn("attempt", F.lit(0)).withColumn("value", value("kind", "key", "gender", "attempt")), "pii-values")
    while True:
        # a value goes to the entity that came to it first (fewest attempts, then the smaller key); all of ``settled`` took fewer
        taken = reduce(DataFrame.unionByName, (x.select("kind", "value") for x in settled), real).withColumn("__taken", F.lit(True))
        owner = new.groupBy("kind", "value").agg(F.min("key").alias("__owner"))
        marked = written(new.join(owner, ["kind", "value"]).join(taken, ["kind", "value"], "left")
                         .select(*cols, (F.col("__taken").isNotNull() | (F.col("key") != F.col("__owner"))).alias("again")), "pii-marked")
        settled.append(marked.where("not again").select(*cols))
        again = marked.where("again").select(*cols)
        if again.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        if len(settled) == 8:  # keeps the plan short
            settled = [written(reduce(DataFrame.unionByName, settled), "pii-settled")]
        new = written(again.withColumn("attempt", F.col("attempt") + 1).drop("value")
                      .withColumn("value", value("kind", "key", "gender", "attempt")), "pii-values")


def replace_pii(docs: DataFrame, secret: bytes, text_col: str = "text", broadcast_rows: int = 100_000) -> DataFrame:
    """``docs`` with a struct ``__pii(text, n_entities, kinds)``."""
    spark = docs.sparkSession
    table = assign(written(entities(docs, text_col), "pii-entities"), secret)
    redrawn = written(table.where("attempt > 0 or mixed").select("kind", "key", "gender", "attempt"), "pii-redrawn")
    out = "text string, n_entities long, kinds string"
    cols = ["text", "n_entities", "kinds"]
    if redrawn.count() <= broadcast_rows:
        told = spark.sparkContext.broadcast({(r.kind, r.key): (r.attempt, r.gender) for r in redrawn.toLocalIterator()})

        @F.pandas_udf(out)
        def run(s: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([rewrite(t or "", told.value, secret) for t in s], columns=cols)

        return docs.withColumn("__pii", run(docs[text_col].cast("string")))

    def mentions(it):
        for b in batches(it):
            rows = {(k1, k2, *x[2:4]) for t, k1, k2 in zip(*(b.column(i).to_pylist() for i in range(3))) for x in detect(t)}
            c = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), *(pa.array(x, pa.string()) for x in c[2:])],
                                             names=["__k1", "__k2", "kind", "key"])

    @F.pandas_udf(out)
    def run_own(s: pd.Series, own: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rewrite(t or "", {} if o is None else {(x["kind"], x["key"]): (x["attempt"], x["gender"]) for x in o}, secret)
                             for t, o in zip(s, own)], columns=cols)

    keyed = docs.withColumns(dict(zip(["__k1", "__k2"], content_key(text_of(docs, text_col)))))
    own = (keyed.select(text_of(keyed, text_col), "__k1", "__k2").mapInArrow(mentions, "__k1 long, __k2 long, kind string, key string")
           .dropDuplicates().join(redrawn, ["kind", "key"])
           .groupBy("__k1", "__k2").agg(F.collect_list(F.struct("kind", "key", "gender", "attempt")).alias("__own")))
    return (keyed.join(own, ["__k1", "__k2"], "left").withColumn("__pii", run_own(F.col(text_col).cast("string"), "__own"))
            .drop("__k1", "__k2", "__own"))


@keeping_columns
def with_surrogates(docs: DataFrame, secret: bytes, **options) -> DataFrame:
    """``docs`` with its text rewritten (null stays null) and, if there is one, ``n_chars`` brought up to date."""
    out = replace_pii(docs, secret, **options)
    new = F.when(F.col("text").isNotNull(), F.col("__pii.text"))
    put = {"text": new}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(F.col("text").isNotNull(), F.length("__pii.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(put).select(*docs.columns)
