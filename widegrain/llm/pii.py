"""PII surrogates: detected entities are replaced by keyed ones of the same type.

An entity's surrogate depends only on the key, its type, its normal form and an attempt
number, so it is the same in every document (coreference) and no table of secrets is
kept. Numbers, codes and addresses go through a keyed permutation of all strings of their
format, which keeps length, signs, case, country code, check digit and octet range; names
are composed from syllables of their script with an ending of their gender, and are the
longer the more names of a kind there are. The key is a secret: who has it can undo the
permutations, so there is no default. The distinct
entities of the corpus are then checked: a surrogate that two entities share, or that is
itself an entity of the corpus, is drawn again, names with one more syllable each time,
until all are distinct.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b
from math import isqrt
from secrets import token_hex
from unicodedata import category, normalize

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from widegrain.llm.common import map_arrow, save, text_slices

#: Redrawn entities that a rewriting task may hold; beyond it they are joined by document.
HELD_REDRAWS = 100_000
KEY_SETTING = "spark.widegrain.pii.key"

#: Titles that announce a person's name, by gender (fixed values).
TITLES = {
    "m": ["Mr", "Sir", "Herr", "Herrn", "Señor", "Sr", "Monsieur", "господин", "г-н"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Sra", "Madame", "Mme", "Mlle", "госпожа", "г-жа"],
    "n": ["Dr", "Prof"],
}
#: Syllables and gendered endings that names are composed from, by script.
SYLLABLES = {
    "latin": ["ba", "del", "fi", "gar", "hol", "jen", "ka", "lor", "mi", "nat", "pe", "ros", "sal", "tem", "vi", "wen"],
    "cyrillic": ["ба", "дел", "фи", "гар", "хол", "жен", "ка", "лор", "ми", "нат", "пе", "рос", "сал", "тем", "ви", "зен"],
    "greek": ["βα", "δελ", "φι", "γαρ", "χολ", "ζεν", "κα", "λορ", "μι", "νατ", "πε", "ροσ", "σαλ", "τεμ", "βι", "θεν"],
}
GIVEN_END = {"latin": {"m": "on", "f": "ina", "n": "is"}, "cyrillic": {"m": "ан", "f": "ина", "n": "ис"}, "greek": {"m": "ων", "f": "ινα", "n": "ις"}}
FAMILY_END = {"latin": {"m": "er", "f": "er", "n": "er"}, "cyrillic": {"m": "ов", "f": "ова", "n": "ко"}, "greek": {"m": "ιδης", "f": "ιδου", "n": "ακη"}}

#: Words that introduce a name without a title (fixed values).
CUES = ["my name is", "name:", "signed by", "mein Name ist", "ich heiße", "je m'appelle", "je m’appelle", "mon nom est", "me llamo", "mi nombre es", "меня зовут", "mi chiamo"]

_TITLE_GENDER = {t: g for g, ts in TITLES.items() for t in ts}


def _class(*wanted: str) -> str:
    """The characters of the given categories, as ranges of a character class."""
    out: list[list[int]] = []
    for c in range(0x1E944):
        if category(chr(c)) in wanted:
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" if a < b else chr(a) for a, b in out)


_UPPER = _class("Lu", "Lt")
_PART = _class("Lu", "Lt", "Ll", "Lm", "Lo", "Mn", "Mc")
_APOSTROPHES = "'’ʼ"
#: A whole word with a capital first, of two letters or more; a possessive 's is not part of it.
_PIECE = rf"[{_UPPER}](?:[{_PART}]|[{_APOSTROPHES}](?!s(?![{_PART}]))(?=[{_PART}]))++"
_WORD = rf"{_PIECE}(?:[-‐‑]{_PIECE})*+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: (type, quick test, pattern); group `v`, if there is one, is the entity.
DETECTORS: list[tuple[str, Callable[[str], bool], re.Pattern]] = [
    ("email", lambda t: "@" in t, re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")),
    ("secret", lambda t: "=" in t or ":" in t, re.compile(r"(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?(?P<v>[A-Za-z0-9+/_.-]{6,}[A-Za-z0-9+/_])")),
    ("access_key", lambda t: "AKIA" in t or "ASIA" in t, re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)(?P<v>[A-Z0-9]{16})(?![A-Za-z0-9])")),
    ("iban", lambda t: True, re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ip", lambda t: True, re.compile(rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)")),
    ("card", lambda t: True, re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])")),
    ("ssn", lambda t: True, re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", lambda t: True, re.compile(r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?![\w-]|\.\d)|(?<![\w+])\+\d{8,15}(?!\w)")),
]
_DIGIT = re.compile(r"\d")
_NAMES = re.compile(rf"(?<!\w)(?P<title>{'|'.join(sorted(map(re.escape, _TITLE_GENDER), key=len, reverse=True))})\.? (?P<name>{_WORD}(?: {_WORD}){{0,2}})")
_CUED = re.compile(rf"(?<!\w)(?i:{'|'.join(map(re.escape, CUES))}) ?(?P<name>{_WORD}(?: {_WORD}){{0,2}})")
_CUE_WORDS = {max(c.replace(":", " ").split(), key=len).lower() for c in CUES}
_CAPITALISED = re.compile(rf"(?<![\w{_PART}{_APOSTROPHES}]){_WORD}")
_NEEDS_DIGIT = {"iban", "ip", "card", "ssn", "phone"}


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normal form) of entities that don't overlap, in order."""
    found: list[tuple[int, int, str, str]] = []
    digits = _DIGIT.search(text) is not None
    for kind, likely, pattern in DETECTORS:
        if (kind in _NEEDS_DIGIT and not digits) or not likely(text):
            continue
        for m in pattern.finditer(text):
            a, b = m.span("v") if "v" in pattern.groupindex else m.span()
            if all(b <= x or a >= y for x, y, _, _ in found):
                found.append((a, b, kind, normal(kind, text[a:b])))
    named: dict[str, str] = {}
    said = [(_TITLE_GENDER[m["title"]], m) for m in _NAMES.finditer(text)]
    lowered = text.lower()
    if any(c in lowered for c in _CUE_WORDS):
        said += [("n", m) for m in _CUED.finditer(text) if m["name"].split(" ")[0] not in _TITLE_GENDER]
    for gender, m in said:
        at = m.start("name")
        words = m["name"].split(" ")
        for i, w in enumerate(words):
            if all(at + len(w) <= x or at >= y for x, y, _, _ in found):
                role = "family" if i == len(words) - 1 else "given"
                kind = f"{role}:{_script(w)}:{gender if role == 'given' or _script(w) != 'latin' else 'n'}"
                found.append((at, at + len(w), kind, normal(kind, w)))
                named.setdefault(normal(kind, w), kind)
            at += len(w) + 1
    if named:
        # The same words without a title are further mentions.
        taken = sorted(found)
        starts = [x[0] for x in taken]
        for m in _CAPITALISED.finditer(text):
            kind = named.get(form := normal("family:", m[0]))
            i = bisect_left(starts, m.end())
            if kind and (not i or taken[i - 1][1] <= m.start()):
                found.append((m.start(), m.end(), kind, form))
    return sorted(found)


def _script(word: str) -> str:
    first = word[0]
    if "Ѐ" <= first <= "ԯ":
        return "cyrillic"
    return "greek" if "Ͱ" <= first <= "Ͽ" or "ἀ" <= first <= "῿" else "latin"


def normal(kind: str, text: str) -> str:
    """The form in which mentions of one entity agree."""
    if ":" in kind:
        return re.sub(f"[{_APOSTROPHES}]", "'", normalize("NFC", text).lower())
    if kind in ("card", "ssn", "phone"):
        d = "".join(c for c in text if c.isdigit())
        return d[-10:] if kind == "phone" and len(d) > 10 else d
    if kind == "iban":
        return text.replace(" ", "")
    return text.lower() if kind == "email" else text


def _draw(key: bytes, label: str, number: int, size: int) -> int:
    raw = blake2b(f"{label}|{number}".encode(), key=key, digest_size=min(64, size.bit_length() // 8 + 9)).digest()
    return int.from_bytes(raw, "big") % size


def permute(x: int, n: int, key: bytes, label: str) -> int:
    """A keyed permutation of 0..n-1: a Feistel network, walked until it is in range."""
    if n < 2:
        return x
    a = isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        left, right = divmod(x, b)
        for r in range(8):
            if r % 2:
                right = (right + _draw(key, f"{label}{r}", left, b)) % b
            else:
                left = (left + _draw(key, f"{label}{r}", right, a)) % a
        x = left * b + right
        if x < n:
            return x


def _alphabets(text: str) -> list[str]:
    if len(text) >= 12 and re.fullmatch(r"[0-9a-f]*[a-f][0-9a-f]*", text):
        return ["0123456789abcdef"] * len(text)
    kinds = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    return [next((k for k in kinds if c in k), c) for c in text]


def permute_text(text: str, key: bytes, label: str) -> str:
    """The keyed permutation of all texts with the same classes of characters."""
    alphabets = _alphabets(text)
    n, x = 1, 0
    for c, k in zip(text, alphabets):
        n, x = n * len(k), x * len(k) + k.index(c)
    mask = "".join(k[0] for k in alphabets)
    x = permute(x, n, key, f"{label}|{mask}")
    out = []
    for k in reversed(alphabets):
        x, r = divmod(x, len(k))
        out.append(k[r])
    return "".join(reversed(out))


#: IPv4 blocks that are not for public hosts: a surrogate stays in its block (fixed values).
IP_BLOCKS = [("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.168.0.0", 16), ("224.0.0.0", 4), ("240.0.0.0", 4)]


def _ip_number(text: str) -> int:
    x = 0
    for part in text.split("."):
        x = x * 256 + int(part)
    return x


def _ip_block(x: int) -> tuple[int, int]:
    """(first address, addresses) of the special block of an address; (0, 0) if it is public."""
    for first, bits in IP_BLOCKS:
        a, size = _ip_number(first), 1 << 32 - bits
        if a <= x < a + size:
            return a, size
    return 0, 0


def _iban_check(bban: str, country: str) -> str:
    """The two check digits, by ISO 7064 mod 97-10."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in bban + country + '00')) % 97:02d}"


def _ssn_valid(form: str) -> bool:
    return form[:3] not in ("000", "666") and form[0] != "9" and form[3:5] != "00" and form[5:] != "0000"


def _luhn(digits: str) -> int:
    """The check digit that completes `digits`."""
    total = sum(sum(divmod(int(c) * (2 if i % 2 == 0 else 1), 10)) for i, c in enumerate(reversed(digits)))
    return -total % 10


@lru_cache(1 << 16)
def surrogate(kind: str, form: str, key: bytes, attempt: int = 0) -> str:
    """The normal form of an entity's replacement."""
    label = f"{kind}|{attempt}"
    if kind == "ip":
        x = _ip_number(form)
        first, size = _ip_block(x)
        if size:
            x = first + permute(x - first, size, key, f"{label}|{first}")
        else:  # walked on until it is public again, which is a permutation of the public ones
            x = permute(x, 1 << 32, key, label)
            while _ip_block(x)[1]:
                x = permute(x, 1 << 32, key, label)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
    if kind == "email":
        local, _, domain = form.rpartition("@")
        head, _, top = domain.rpartition(".")
        return permute_text(f"{local}@{head}", key, f"{label}|{top}") + "." + top
    if kind == "card":
        checked = _luhn(form[:-1]) == int(form[-1])
        body = form[0] + permute_text(form[1:-1] if checked else form[1:], key, f"{label}|{form[0]}|{checked}")
        return body + str(_luhn(body)) if checked else body
    if kind == "iban":
        country, bban = form[:2], form[4:]
        if form[2:4] != _iban_check(bban, country):
            return country + permute_text(form[2:], key, f"{label}|{country}|unchecked")
        bban = permute_text(bban, key, f"{label}|{country}")
        return country + _iban_check(bban, country) + bban
    if kind == "ssn" and _ssn_valid(form):
        form = permute_text(form, key, label)
        while not _ssn_valid(form):
            form = permute_text(form, key, label)
        return form
    if kind == "phone":
        # An area code keeps a first digit of 2 to 9 where it has one.
        low = "2" <= form[0] <= "9"
        first = permute(int(form) - (2 if low else 0) * 10 ** (len(form) - 1), (8 if low else 2) * 10 ** (len(form) - 1), key, f"{label}|{low}|{len(form)}")
        return str(first + (2 if low else 0) * 10 ** (len(form) - 1)).zfill(len(form))
    if ":" in kind:
        role, script, gender = kind.split(":")
        parts = SYLLABLES[script]
        # A syllable more for each attempt: the space outgrows any number of entities.
        x = _draw(key, f"{role}|{script}|{attempt}", int.from_bytes(form.encode(), "big"), len(parts) ** (4 + attempt))
        short = role == "given" and not attempt and x >> 14
        body = "".join(parts[x >> 4 * i & 15] for i in range(2 if short else 3 + attempt))
        return body + (GIVEN_END if role == "given" else FAMILY_END)[script][gender]
    return permute_text(form, key, label)


def lay_out(kind: str, shown: str, form: str) -> str:
    """A surrogate's normal form in the layout of the mention it replaces."""
    if ":" in kind:
        return form.upper() if shown.isupper() else form[:1].upper() + form[1:]
    if kind in ("card", "ssn", "phone", "iban"):
        slots = [i for i, c in enumerate(shown) if (c != " " if kind == "iban" else c.isdigit())]
        out = list(shown)
        for i, c in zip(slots[len(slots) - len(form) :], form):
            out[i] = c
        return "".join(out)
    if kind == "email":
        return "".join(c.upper() if s.isupper() else c for s, c in zip(shown, form))
    return form


def first_attempt(kind: str, entities: int) -> int:
    """The attempt that a kind's draws begin with: names get room for 32 times their number."""
    if ":" not in kind:
        return 0
    a = 0
    while entities > 32 and 16 ** (3 + a) < 32 * entities:
        a += 1
    return a


def rewrite(text: str, key: bytes, redrawn: dict[tuple[str, str], int], base: dict[str, int] | None = None) -> tuple[str, int]:
    """The text with every entity replaced, and their number."""
    base = base or {}
    out, last = [], 0
    found = detect(text)
    for a, b, kind, form in found:
        out += [text[last:a], lay_out(kind, text[a:b], surrogate(kind, form, key, redrawn.get((kind, form), base.get(kind, 0))))]
        last = b
    return "".join([*out, text[last:]]), len(found)


def mentions(docs: DataFrame) -> DataFrame:
    """(kind, form): the distinct entities of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            seen = {(k, f) for t in part.column(0).to_pylist() if t for _, _, k, f in detect(t)}
            yield pa.RecordBatch.from_pydict({"kind": [k for k, _ in seen], "form": [f for _, f in seen]}, pa.schema([("kind", pa.string()), ("form", pa.string())]))

    return map_arrow(docs.select("text"), run, "kind string, form string").distinct()


def first_attempts(entities: DataFrame) -> dict[str, int]:
    """For each kind; kinds are few, whatever the corpus."""
    return {r["kind"]: first_attempt(r["kind"], r["count"]) for r in entities.groupBy("kind").count().collect()}


def redraws(entities: DataFrame, key: bytes, base: dict[str, int] | None = None, rounds: int = 20) -> DataFrame:
    """(kind, form, attempt): the entities whose first surrogate was taken.

    A surrogate is taken if another entity of its kind has it (the least form keeps it)
    or if it is an entity of the corpus itself. Redrawn until all are distinct.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, forms, tries = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            made = [surrogate(k, f, key, t) for k, f, t in zip(kinds, forms, tries)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], ["kind", "form", "attempt", "made"])

    base = first_attempts(entities) if base is None else base
    later = [F.when(F.col("kind") == k, a) for k, a in sorted(base.items()) if a]
    begin = F.coalesce(*later, F.lit(0))
    drawn = save(map_arrow(entities.withColumn("attempt", begin.cast("int")), draw, "kind string, form string, attempt int, made string"))
    real = entities.select(F.col("kind").alias("rk"), F.col("form").alias("rf"))
    for _ in range(rounds):
        owner = drawn.groupBy("kind", "made").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "form")).alias("o")).where("n > 1")
        owner = owner.select(F.col("kind").alias("ok"), F.col("made").alias("om"), F.col("o.form").alias("of"))
        shared = drawn.join(owner, (F.col("kind") == F.col("ok")) & (F.col("made") == F.col("om"))).where("form <> of").select("kind", "form", "attempt")
        named = drawn.join(real, (F.col("kind") == F.col("rk")) & (F.col("made") == F.col("rf"))).select("kind", "form", "attempt")
        taken = save(shared.union(named).distinct())
        if taken.isEmpty():
            break
        again = map_arrow(taken.select("kind", "form", (F.col("attempt") + 1).alias("attempt")), draw, "kind string, form string, attempt int, made string")
        drawn = save(drawn.join(taken.select("kind", "form"), ["kind", "form"], "left_anti").unionByName(again))
    else:
        raise RuntimeError("surrogates did not become distinct; use another key")
    return drawn.where(F.col("attempt") > begin).select("kind", "form", "attempt")


def session_key(spark: SparkSession) -> str:
    """The secret of the session's setting KEY_SETTING; without one, a new secret for this run."""
    return spark.conf.get(KEY_SETTING, None) or token_hex(32)


def replace_pii(docs: DataFrame, key: str, held: int = HELD_REDRAWS) -> DataFrame:
    """`docs` with surrogates in text, and the new column n_replaced.

    `key` is a secret; the same key gives the same surrogates in another run.

    Every row comes back, other columns unchanged; a null text stays null with 0
    replaced. Equal rows get equal results; an empty table gives none.
    """
    secret = blake2b(key.encode(), digest_size=32).digest()
    entities = save(mentions(docs))
    base = first_attempts(entities)
    again = redraws(entities, secret, base)
    few = again.limit(held + 1).count() <= held
    table = {(r["kind"], r["form"]): r["attempt"] for r in again.collect()} if few else {}
    fields = [f for f in docs.schema.fields if f.name not in ("text", "n_replaced")]
    rows = docs.select(*[F.col(f.name).alias(f"c{i}") for i, f in enumerate(fields)], F.col("text").alias("__text"))
    rows = rows.withColumn("__own", F.array().cast("array<string>")) if few else _with_own_redraws(rows, again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "__text"):
            n = part.num_columns
            texts, counts = [], []
            for t, own in zip(part.column(n - 2).to_pylist(), part.column(n - 1).to_pylist()):
                mine = table
                if own:
                    mine = {(k, f): int(a) for k, f, a in (x.split("\x1f") for x in own)}
                done, count = rewrite(t, secret, mine, base) if t else (t, 0)
                texts.append(done)
                counts.append(count)
            yield pa.RecordBatch.from_arrays([*part.columns[: n - 2], pa.array(texts, pa.string()), pa.array(counts, pa.int64())], [*part.schema.names[: n - 2], "text", "n_replaced"])

    schema = "".join(f"c{i} {f.dataType.simpleString()}, " for i, f in enumerate(fields)) + "text string, n_replaced long"
    out = map_arrow(rows, run, schema)
    named = {f.name: F.col(f"c{i}").alias(f.name) for i, f in enumerate(fields)}
    return out.select(*[named.get(c, F.col(c)) for c in docs.columns if c != "n_replaced"], "n_replaced")


def _with_own_redraws(rows: DataFrame, again: DataFrame) -> DataFrame:
    """Each text with the redrawn entities that it mentions, joined by the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "__text"):
            out = [(h, k, f) for t, h in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if t for k, f in {(k, f) for _, _, k, f in detect(t)}]
            yield pa.RecordBatch.from_pydict({"h": [x[0] for x in out], "kind": [x[1] for x in out], "form": [x[2] for x in out]}, pa.schema([("h", pa.int64()), ("kind", pa.string()), ("form", pa.string())]))

    keyed = rows.withColumn("__h", F.xxhash64("__text"))
    said = map_arrow(keyed.select("__text", "__h"), run, "h long, kind string, form string").distinct()
    own = said.join(again, ["kind", "form"]).groupBy("h").agg(F.collect_list(F.concat_ws("\x1f", "kind", "form", F.col("attempt").cast("string"))).alias("__own"))
    return keyed.join(own, F.col("__h") == F.col("h"), "left").drop("__h", "h")


def query(spark, sf_dir: str) -> DataFrame:
    """op8 over all documents: doc_id, the rewritten text and the number of replacements."""
    return replace_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), session_key(spark))
