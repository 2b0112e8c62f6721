"""Personal data replaced by keyed surrogates of the same type, gender, script and format."""

from __future__ import annotations

import hashlib
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculo.functions.runtime import ROW, materialize, small, with_rows
from vinculo.llm.texts import map_batches

MAX_ATTEMPTS = 24

# Titles with the gender they state, given names by script and gender, parts of family names by script.
TITLES = {
    "mr": "m", "mister": "m", "sir": "m", "herr": "m", "monsieur": "m", "señor": "m", "sr": "m", "don": "m", "господин": "m", "κύριος": "m",
    "mrs": "f", "ms": "f", "miss": "f", "madam": "f", "frau": "f", "madame": "f", "mme": "f", "mademoiselle": "f", "señora": "f", "sra": "f",
    "señorita": "f", "doña": "f", "госпожа": "f", "κυρία": "f", "dr": "n", "prof": "n", "professor": "n", "доктор": "n",
}
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Nils Oscar Paul Robert Simon Tomas Victor".split(),
    ("latin", "f"): "Ada Berta Clara Diana Elena Frida Greta Helena Ida Julia Karin Laura Maria Nora Olga Paula Rosa Sara Teresa Vera".split(),
    ("latin", "n"): "Alex Andrea Chris Dana Eden Jamie Jules Kim Lou Noa Robin Sam Sascha Taylor Toni Yael".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Лев Марк Олег Павел Роман".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Инна Лидия Мария Нина Ольга Раиса София".split(),
    ("cyrillic", "n"): "Саша Женя Валя Паша Шура Слава".split(),
    ("greek", "m"): "Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
    ("greek", "f"): "Άννα Ελένη Ζωή Κατερίνα Μαρία Σοφία".split(),
    ("greek", "n"): "Αλέξης Χρύσα Φοίβη".split(),
} | {(script, gender): names.split() for script, by in {
    "han": {"m": "伟明 志强 建国 大輔 健太", "f": "美玲 秀英 丽华 花子 由美", "n": "文清 晓雨 子安 千秋"},
    "hangul": {"m": "민준 서준 도윤 지호", "f": "서연 지우 하은 수빈", "n": "지원 하늘 가람"},
    "arabic": {"m": "كريم سامي طارق نبيل", "f": "ليلى سلمى هند رانيا", "n": "نور صباح رجاء"},
    "hebrew": {"m": "אורי דוד יוסף משה", "f": "רחל שרה תמר מרים", "n": "נועם טל שחר"},
}.items() for gender, names in by.items()}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo".split(),
    "cyrillic": "ба бе бо да де до га го ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то ва ве во".split(),
    "greek": "βα βε βο δα δε δο γα κα κε κο λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε σο τα τε το".split(),
    "han": list("田山川林森石松竹梅高中小大上下平安本井村"), "hangul": list("가나다라마바사아자차카타파하고노도로모보소오조"),
    "arabic": list("بتجحدرزسصطعفقكلمنهوي"), "hebrew": list("אבגדהוזחטילמנסעפצקרשת"),
}
#: Lower-case words within names.
PARTICLES = set("van von de del della der den di da dos du la le ten ter zu bin ibn al el af y".split())
ENDINGS = {"latin": ("n", "r", "s", "l"), "cyrillic": ("н", "р", "в", "л"), "greek": ("ς", "ν"), "han": tuple("野原木田"), "hangul": tuple("김박이최"), "arabic": tuple("انير"), "hebrew": tuple("לנרי")}

EMAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
DIGITS = re.compile(
    r"(?<![\w.])(?:"
    r"(?P<ip>(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3})(?![\w]|\.\d)"
    r"|(?P<card>\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{13,19})(?!\w)"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?P<phone>\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)"
    r")")
TOKEN = re.compile(r"(?<!\w)(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?!\w)")
TITLED = re.compile(rf"(?<!\w)({'|'.join(sorted(TITLES, key=len, reverse=True))})\b\.?[ \t]+(?=[^\W\d_])", re.I)
WORD = re.compile(r"[^\W\d_](?:\.(?=[ \t]+[^\W\d_])|[\w'’-]*)")
GAP = re.compile(r"[ \t]+(?=[^\W\d_])")
#: Where a number may begin, where a long hexadecimal string may be, and words: cheap tests before the patterns above.
STARTS, LONG, TOKENS = re.compile(r"[\d+(]"), re.compile(r"[0-9a-fA-F]{32}"), re.compile(r"\w+")


def script_of(word: str) -> str:
    name = unicodedata.name(next((c for c in word if c.isalpha()), "a"), "")
    first = name.split(" ")[0]
    return "han" if first in ("CJK", "HIRAGANA", "KATAKANA") else first.lower() if first in ("CYRILLIC", "GREEK", "HANGUL", "ARABIC", "HEBREW") else "latin"


def _caseless(word: str) -> bool:
    return word.lower() == word.upper()


def _name_at(text: str, at: int, title: str) -> tuple[int, list[str]]:
    """The end and the words of the name that begins at ``at``.

    All words that begin with a capital letter belong to it, with initials, and particles before such words. Where
    case tells nothing (scripts without case, capital letters throughout) two words are taken at most.
    """
    words: list[str] = []
    end, pending = at, []
    while m := WORD.match(text, at):
        word, stop = m[0], m.end()
        if word[-2:] in ("'s", "’s", "'S", "’S"):
            word, stop = word[:-2], stop - 2
        blind = _caseless(word) or (title.isupper() and len(title) > 1 and word.isupper())
        if (word[0].isupper() and (len(word) > 1 or len(words) > 0)) or _caseless(word):
            if blind and len(words) + len(pending) >= 2:
                break
            words += [*pending, word]
            end, pending = stop, []
        elif word in PARTICLES:
            pending.append(word)
        else:
            break
        gap = GAP.match(text, stop)
        if not gap or stop < m.end():
            break
        at = gap.end()
    return end, words


def _mentions(text: str, people: list[tuple[str, list[str]]]) -> list[tuple[int, int, str, str]]:
    """Mentions without a title of ``people`` (gender, words of the name): whole names, family names, given names."""
    names: dict[str, tuple[str, str]] = {}
    for gender, words in people:
        names.setdefault(" ".join(words), (f"person-{gender}", " ".join(words)))
        names.setdefault(words[-1], (f"person-{gender}", words[-1]))
    for gender, words in people:
        for i, word in enumerate(words[:-1]):
            if len(word) > 1 and word[-1] != "." and word not in PARTICLES:
                names.setdefault(word, (f"given{i}-{gender}", " ".join(words)))
    if not names:
        return []
    inner = lambda n: re.escape(n).replace("\\ ", "[ \\t]+")
    alone = [inner(n) for n in sorted(names, key=len, reverse=True) if script_of(n) in ("han", "hangul") and len(n) > 1]
    spaced = [inner(n) for n in sorted(names, key=len, reverse=True)]
    found = re.compile("|".join([*alone, rf"(?<!\w)(?:{'|'.join(spaced)})(?!\w)"]), re.I)
    out = []
    for m in found.finditer(text):
        known = names.get(" ".join(m[0].split()).casefold())
        if known and (m[0][0].isupper() or _caseless(m[0]) or m[0].split()[0] in PARTICLES):
            out.append((m.start(), m.end(), *known))
    return out


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the entities in a text, without overlaps, in order."""
    if not text:
        return []
    spans = []
    if "@" in text:
        spans += [(m.start(), m.end(), "email", m[0].lower()) for m in EMAIL.finditer(text)]
    at = 0
    while start := STARTS.search(text, at):
        m = DIGITS.match(text, start.start())
        at = m.end() if m else start.end()
        if m:
            kind = m.lastgroup
            spans.append((m.start(), m.end(), kind, m[0] if kind == "ip" else re.sub(r"\D", "", m[0])))
    if LONG.search(text):
        spans += [(m.start(), m.end(), "token", m[0].lower()) for m in TOKEN.finditer(text)]
    people = []
    for m in () if TITLES.keys().isdisjoint(TOKENS.findall(text.lower())) else TITLED.finditer(text):
        end, words = _name_at(text, m.end(), m[1])
        if words:
            people.append((TITLES[m[1].lower()], [w.casefold() for w in words]))
            spans.append((m.end(), end, f"person-{people[-1][0]}", " ".join(people[-1][1])))
    if people:
        spans += _mentions(text, people)
    spans.sort(key=lambda s: (s[0], -s[1]))
    out, at = [], 0
    for s in spans:
        if s[0] >= at:
            out.append(s)
            at = s[1]
    return out


class Stream:
    """Keyed pseudo-random choices for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, canonical: str, attempt: int) -> None:
        self.seed = hashlib.blake2b(f"{kind}\0{canonical}\0{attempt}".encode(), key=key, digest_size=32).digest()
        self.pool, self.round = int.from_bytes(self.seed, "big"), 0

    def below(self, n: int) -> int:
        if self.pool < n << 32:
            self.round += 1
            self.pool = int.from_bytes(hashlib.blake2b(self.seed + self.round.to_bytes(4, "big"), digest_size=64).digest(), "big")
        self.pool, x = divmod(self.pool, n)
        return x


def _luhn(digits: str) -> int:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10


def surrogate(key: bytes, kind: str, canonical: str, attempt: int = 0) -> str:
    """The canonical form of the replacement; each further attempt gives another one."""
    s = Stream(key, kind, canonical, attempt)
    if kind == "email":
        local, _, host = canonical.partition("@")
        extra = "".join("abcdefghijkmnpqrstuvwxyz"[s.below(24)] for _ in range(attempt))
        shape = lambda t, r: "".join(str(r.below(10)) if c.isdigit() else chr(97 + r.below(26)) if c.isalpha() else c for c in t)
        labels = host.split(".")
        tail = f"example.{labels[-1] if labels[-1] in ('com', 'org', 'net') else 'com'}"
        inner = [shape(x, Stream(key, "host", host, i)) for i, x in enumerate(labels[:-2])] or [shape("aaaa", Stream(key, "host", host, 0))]
        return f"{shape(local, s)}{extra}@{'.'.join(inner)}.{tail}"
    if kind == "ip":
        first = canonical.split(".")
        if attempt >= MAX_ATTEMPTS // 3:  # the private ranges are small: the widest one, then public addresses
            first = ["10"] if attempt < 2 * MAX_ATTEMPTS // 3 else ["0"]
        keep = 1 if first[0] in ("10", "127") else 2 if first[:2] == ["192", "168"] or (first[0] == "172" and len(first) > 1 and 16 <= int(first[1]) <= 31) else 0
        return ".".join(first[:keep] + [str(1 + s.below(223 if i == 0 else 254)) for i in range(keep, 4)])
    if kind == "card":
        body = canonical[0] + "".join(str(s.below(10)) for _ in canonical[1:-1])
        check = (-_luhn(body + "0")) % 10
        valid = _luhn(canonical) == 0
        return body + str(check if valid else (check + 1 + s.below(9)) % 10)
    if kind in ("phone", "ssn"):
        keep = 1 if kind == "phone" and len(canonical) > 10 else 0
        more = "".join(str(s.below(10)) for _ in range(attempt // 4))  # few digits have few surrogates: later attempts are longer
        return canonical[:keep] + str(2 + s.below(8)) + "".join(str(s.below(10)) for _ in canonical[keep + 1 :]) + more
    if kind == "token":
        return "".join("0123456789abcdef"[s.below(16)] for _ in canonical)
    if kind.startswith("given"):
        return surrogate(key, f"person-{kind[-1]}", canonical, attempt).split()[int(kind[5:-2])]
    names = canonical.split()
    if kind == "surname":
        script = script_of(canonical)
        parts = "".join(SYLLABLES[script][s.below(len(SYLLABLES[script]))] for _ in range(3 + attempt // 4))
        return (parts + ENDINGS[script][s.below(len(ENDINGS[script]))]).casefold()
    base, attempt = divmod(attempt, MAX_ATTEMPTS)  # of the family name, of the given names
    given = GIVEN[script_of(canonical), kind[-1]]
    chosen = ["-".join(given[s.below(len(given))] for _ in range(1 if i else 1 + attempt // 4)) for i in range(len(names) - 1)]
    return " ".join([*chosen, surrogate(key, "surname", names[-1], base)]).casefold()


def rendered(kind: str, original: str, canonical: str) -> str:
    """A canonical form in the format of the occurrence: its separators and its letter case."""
    if kind in ("card", "phone", "ssn"):
        digits = iter(canonical)
        return "".join(next(digits, "") if c.isdigit() else c for c in original) + "".join(digits)
    if original.upper() == original and original.lower() != original:
        return canonical.upper()
    return canonical.title() if kind.startswith(("person", "given")) else canonical


def person_of(kind: str) -> str:
    """The kind whose attempts hold for an occurrence: a given name follows its person."""
    return f"person-{kind[-1]}" if kind.startswith("given") else kind


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, canonical, n): the distinct entities of each document and their occurrences."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"id": [], "kind": [], "canonical": [], "n": []}
        for i, t in zip(batch["id"], batch["text"], strict=True):
            counts: dict[tuple[str, str], int] = {}
            for _, _, kind, canonical in find(t):
                kind = person_of(kind)
                counts[kind, canonical] = counts.get((kind, canonical), 0) + 1
            for (kind, canonical), n in counts.items():
                for name, x in zip(out, (i, kind, canonical, n), strict=True):
                    out[name].append(x)
        return out

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(own, run, "id long, kind string, canonical string, n int")


def _settled(known: DataFrame, key: bytes) -> DataFrame:
    """(kind, canonical, attempt, surrogate) for ``known(kind, canonical, attempt)``, each from its own attempt on.

    Rivals are the entities of one kind, all kinds of persons together.
    """

    def run(batch: dict[str, list]) -> dict[str, list]:
        return batch | {"surrogate": [surrogate(key, *x) for x in zip(batch["kind"], batch["canonical"], batch["attempt"], strict=True)]}

    family = lambda: F.when(F.col("kind").startswith("person-"), "person").otherwise(F.col("kind"))
    known = materialize(known)
    taken, open_ = None, known
    for _ in range(MAX_ATTEMPTS):
        tried = map_batches(open_, run, "kind string, canonical string, attempt int, surrogate string").withColumn("group", family())
        real = known.select(family().alias("k"), F.col("canonical").alias("c")).distinct()
        tried = tried.join(real, (F.col("group") == F.col("k")) & (F.col("surrogate") == F.col("c")), "left").withColumn("rival", F.col("c").isNotNull()).drop("k", "c")
        if taken is not None:
            used = taken.select(family().alias("k"), F.col("surrogate").alias("s")).distinct()
            tried = tried.join(used, (F.col("group") == F.col("k")) & (F.col("surrogate") == F.col("s")), "left").withColumn("rival", F.col("rival") | F.col("s").isNotNull()).drop("k", "s")
        tried = materialize(tried)
        first = tried.where("not rival").groupBy("group", "surrogate").agg(F.min("canonical").alias("winner"))
        judged = materialize(tried.join(first, ["group", "surrogate"], "left").withColumn("wins", ~F.col("rival") & F.col("canonical").eqNullSafe(F.col("winner"))))
        won = judged.where("wins").select("kind", "canonical", "attempt", "surrogate")
        taken = won if taken is None else taken.unionByName(won)
        open_ = judged.where("not wins").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt"))
        if open_.isEmpty():
            return taken
    raise RuntimeError(f"surrogates still collide after {MAX_ATTEMPTS} attempts")


def collision_free(known: DataFrame, key: bytes) -> DataFrame:
    """(kind, canonical, attempt, surrogate) for distinct entities ``known(kind, canonical)``.

    Two entities of one kind, or two persons of whatever titles, never get one surrogate, and no
    surrogate equals an entity of the corpus. All take attempt 0; of those that collide all but the
    first take the next, and so on. Family names are settled first, each the same in all persons
    that bear it; then the given names of those that share one. A person's attempt holds both:
    ``MAX_ATTEMPTS`` times that of the family name, plus that of the given names.
    """
    known = materialize(known)
    person = F.col("kind").startswith("person-")
    people = known.where(person).withColumn("family", F.element_at(F.split("canonical", " "), -1))
    names = people.select(F.lit("surname").alias("kind"), F.col("family").alias("canonical")).distinct()
    plain = materialize(_settled(known.where(~person).select("kind", "canonical").unionByName(names).withColumn("attempt", F.lit(0)), key))
    settled = plain.where("kind = 'surname'").select(F.col("canonical").alias("family"), (F.col("attempt") * MAX_ATTEMPTS).alias("attempt"), "surrogate")
    people = materialize(people.join(settled, "family"))
    alone = people.where("canonical = family").select("kind", "canonical", "attempt", "surrogate")
    full = _settled(people.where("canonical <> family").select("kind", "canonical", "attempt"), key)
    return plain.where("kind <> 'surname'").unionByName(alone).unionByName(full)


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, text, n_entities), its entities replaced by surrogates.

    Emails, phone and card numbers, IPv4 addresses, social-security-like numbers, hexadecimal
    secrets and titled names are detected, and the other mentions of these names in the document. A
    family name has one surrogate whatever the title; the title's gender picks the given names. The surrogate depends on the key, the kind and the
    entity, so one entity has one surrogate in all documents. Format, check digit, letter case,
    script and the gender that the title states are kept; where a format has fewer surrogates than
    the corpus has entities, those that would collide get more digits, or an address of a wider range. Most surrogates follow from the key
    alone; only the entities that a collision moved to a later attempt travel to the documents
    that hold them. Null text stays null with 0 entities, clean text is unchanged; very long texts are replaced whole; rows without an id and rows that
    repeat an id are documents of their own; an empty table an empty result; other columns are not read.
    """
    rows, _ = with_rows(docs, id_col, text_col)
    held = materialize(entities(rows, ROW, text_col))
    moved = collision_free(held.select("kind", "canonical").distinct(), key).where("attempt > 0")
    moved = held.join(moved, ["kind", "canonical"]).groupBy("id").agg(F.collect_set(F.struct("kind", "canonical", "attempt")).alias("moved"))
    moved = materialize(moved)

    def run(batch: dict[str, list]) -> dict[str, list]:
        texts, counts = [], []
        for t, changes in zip(batch["text"], batch["moved"], strict=True):
            attempts = {(c["kind"], c["canonical"]): c["attempt"] for c in changes or ()}
            parts, at, found = [], 0, find(t)
            for a, b, kind, canonical in found:
                parts += [t[at:a], rendered(kind, t[a:b], surrogate(key, kind, canonical, attempts.get((person_of(kind), canonical), 0)))]
                at = b
            texts.append("".join(parts) + t[at:] if found else t)
            counts.append(len(found))
        return {"id": batch["id"], "text": texts, "n_entities": counts}

    own = rows.select(F.col(ROW).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    joined = own.join(small(moved.withColumnRenamed("id", "row")), "row", "left").select("id", "text", "moved")
    return map_batches(joined, run, "id long, text string, n_entities int").select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_entities")
