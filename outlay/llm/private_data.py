"""Private data replaced by surrogates, with built-in functions alone.

Found are e-mail addresses, IPv4 addresses, payment-card numbers, telephone numbers and titled names. Every distinct
entity gets one keyed surrogate of its own type: addresses, numbers and names keep length, case, separators and script;
card numbers keep a valid or invalid check digit as it was; names keep the title, and first names are drawn from names of
the same gender and script. As the surrogate depends on the entity alone, all mentions of it, in all texts, read alike.

A titled name is any number of words: initials, inner capitals, hyphens and apostrophes belong to it, small particles ("van")
stay. Its words are replaced one by one. A last name has one surrogate whatever title or first name comes before it, so all
mentions of a person share it; a first name has one too, unless two full names would become the same. Then one of them gets
another first name, in later rounds more of them. Words are compared as written: 'Smith' and 'SMITH' are two names.

Surrogates are checked: one that another entity has too, or that equals any entity of the data, is drawn again with the next
round number until none is left (the entity that sorts first keeps its surrogate). After a round without progress, and from
round ``ROUNDS`` on, e-mail addresses, telephone numbers and names get one more place, so short forms with more entities than
surrogates come to an end too. So distinct entities stay distinct. Rounds work on
distinct entities, in the shared folder; the number of colliding ones falls with each.

Texts without an entity are not shuffled. Distinct texts with one are named by 128-bit hashes, so a hot text is worked on once; its
copies meet their surrogates in a join that the adaptive planner splits. Null and empty texts stay as they are; rows with a null
id, repeated rows and empty tables need nothing special; other columns are passed on untouched, whatever their names. All texts
are searched once, in time that grows with their length, also where one word or one address is very long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.llm.common import stored, table

KEY = "outlay"
#: Rounds of drawing after which surrogates grow by one place a round.
ROUNDS = 8
# A name word: an initial before another name, or a capital and letters, with parts after hyphens and apostrophes but not 's.
_PART = r"[\p{L}\p{M}]*+"
_WORD = rf"\p{{Lu}}{_PART}(?:['’-](?!s(?!\p{{L}}))\p{{L}}{_PART})*+"
_INITIAL = r"\p{Lu}\.(?:-?\p{Lu}\.)*+"
_NAME = rf"(?:{_INITIAL}(?= ?\p{{Lu}})|{_WORD})"
# Particles of last names.
_PARTICLE = r"(?: (?:van|von|der|den|de|del|della|di|da|du|dos|la|le|bin|ibn|ter|ten|zu|zur))*+"
# Titles by gender.
MEN = ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
WOMEN = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Госпожа", "Κυρία")
_TITLES = "|".join(sorted(MEN + WOMEN, key=lambda t: (-len(t), t)))
# An address starts at a border of its characters, so that a long word is walked once: marks before it are left out, unless there
# are more than 64. Domains have at most 127 labels of 63 characters, as in DNS; the count keeps the matcher's recursion short.
_LOCAL = "A-Za-z0-9._%+-"
_START = rf"(?:(?=[A-Za-z0-9])(?<![A-Za-z0-9])(?<=(?<![{_LOCAL}])[._%+-]{{0,64}})|(?<![{_LOCAL}])[._%+-]{{65,}}+)"
KINDS = (
    ("email", rf"{_START}[A-Za-z0-9][{_LOCAL}]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]{{1,63}}){{0,126}}\.[A-Za-z]{{2,}}"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)"),
    ("phone", r"(?<![\w+])\+(?=\d(?:[ .-]?\(?\d\)?){6})\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\d)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"),
    ("card", r"(?<![\w.-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])"),
    ("name", rf"(?<!\p{{L}})(?:{_TITLES})\.?{_PARTICLE} {_NAME}(?:{_PARTICLE} ?{_NAME})*+"),
)
ANY = "|".join(f"(?:{p})" for _, p in KINDS)
# First names by script and gender.
FIRST = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "David", "Erik", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Leon", "Martin", "Noel", "Oscar", "Paul"),
    ("latin", "f"): ("Anna", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Hanna", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Олег"),
    ("cyrillic", "f"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"),
    ("greek", "m"): ("Γιώργος", "Νίκος", "Πέτρος", "Σπύρος"),
    ("greek", "f"): ("Άννα", "Ελένη", "Μαρία", "Σοφία"),
}
_SCRIPTS = {"cyrillic": (r"\p{IsCyrillic}", "бвгдклмнпрст", "аеиоу"), "greek": (r"\p{IsGreek}", "βγδκλμνπρστ", "αειου"), "latin": ("", "bdfgklmnprst", "aeiou")}


def kind_of(entity: Column) -> Column:
    return F.coalesce(*[F.when(entity.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in KINDS], F.when(entity.rlike(r"^[+(]?\d"), F.lit("phone")), F.lit("name"))


# ----- surrogates -----


def _drawn(seed: Column, i: Column, n: int) -> Column:
    """A number below n for place i: four hex digits of a keyed hash, a fresh one every sixteen places."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", seed, (i / 16).cast("int").cast("string")), 256), F.pmod(i, F.lit(16)) * 4 + 1, F.lit(4)), 16, 10).cast("long"), F.lit(n))


def _pick(letters: str, k: Column) -> Column:
    return F.substring(F.lit(letters), k.cast("int") + 1, F.lit(1))


def _redrawn(text: Column, seed: Column) -> Column:
    """ASCII letters and digits drawn anew in place; all else and the case stay."""
    one = lambda c, i: (
        F.when(c.rlike("[0-9]"), _pick("0123456789", _drawn(seed, i, 10)))
        .when(c.rlike("[a-z]"), _pick("abcdefghijklmnopqrstuvwxyz", _drawn(seed, i, 26)))
        .when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _drawn(seed, i, 26)))
        .otherwise(c)
    )
    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Check sum modulo 10 of a text of digits."""
    back = F.split(F.reverse(digits), "")
    worth = lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") < 5, c.cast("int") * 2).otherwise(c.cast("int") * 2 - 9)
    return F.pmod(F.aggregate(F.transform(back, worth), F.lit(0), lambda a, x: a + x), F.lit(10))


def _card(text: Column, seed: Column) -> Column:
    """Digits drawn anew; the last one makes the check sum what it was."""
    drawn = _redrawn(text, seed)
    bare = lambda c: F.regexp_replace(c, "[^0-9]", "")
    cut = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    last = F.pmod(_luhn(bare(text)) - _luhn(F.concat(bare(cut), F.lit("0"))), F.lit(10))
    return F.concat(cut, last.cast("string"))


def _ip(seed: Column) -> Column:
    return F.concat_ws(".", *[(_drawn(seed, F.lit(k), 254) + 1).cast("string") for k in range(4)])


def _email(text: Column, seed: Column, longer: int) -> Column:
    """All but the last label drawn anew."""
    at = F.length(text) - F.length(F.substring_index(text, ".", -1))
    return F.concat(_redrawn(F.concat(F.lit("a" * longer), F.substring(text, F.lit(1), at)), seed), F.substring_index(text, ".", -1))


def _phone(text: Column, seed: Column, longer: int) -> Column:
    """The country code stays if digits follow it."""
    code = F.regexp_extract(text, r"^\+\d{1,3}(?=\D.*\d)", 0)
    return F.concat(code, _redrawn(F.concat(F.substring(text, F.length(code) + 1, F.length(text)), F.lit("0" * longer)), seed))


def _words(entity: Column) -> Column:
    """The words of a titled name without the title, initials apart."""
    title = F.regexp_extract(entity, r"^[^ ]+", 0)
    return F.split(F.regexp_replace(F.substring(entity, F.length(title) + 2, F.length(entity)), r"\.(?=\p{Lu})", ". "), " ")


def _by_script(text: Column, made) -> Column:
    """``made(script)`` for the script of ``text``."""
    tests = [(script, test) for script, (test, _, _) in _SCRIPTS.items() if test]
    return F.coalesce(*[F.when(text.rlike(test), made(script)) for script, test in tests], made("latin"))


def _last(word: Column, seed: Column, longer: int) -> Column:
    letters = lambda script: enumerate(_SCRIPTS[script][1:] * (4 + longer))
    return _by_script(word, lambda script: F.initcap(F.concat(*[_pick(x, _drawn(seed, F.lit(20 + k), len(x))) for k, x in letters(script)])))


def _name(text: Column, last: Column, key: str, attempt: Column, longer: int) -> Column:
    """Title, a drawn name or initial for each word but the last, more names if ``longer``, and the surrogate of the last word."""
    title, words = F.regexp_extract(text, r"^[^ ]+", 0), _words(text)
    woman = F.regexp_replace(title, r"\.$", "").isin(*WOMEN)
    seed = lambda word, k: F.concat_ws("|", F.lit(key), F.lit("first"), word, attempt.cast("string"), F.lit(str(k)))
    name = lambda word, k: _by_script(word, lambda script: F.when(woman, _of(FIRST[script, "f"], seed(word, k))).otherwise(_of(FIRST[script, "m"], seed(word, k))))
    initial = lambda word: F.concat(_by_script(word, lambda x: F.upper(_pick(_SCRIPTS[x][1], _drawn(seed(word, 0), F.lit(3), len(_SCRIPTS[x][1]))))), F.lit("."))
    one = lambda word: F.when(word.rlike(r"^\p{Ll}"), word).when(word.rlike(r"\.$"), initial(word)).otherwise(name(word, 0))
    front = F.transform(F.slice(words, F.lit(1), F.size(words) - 1), one)
    more = [name(F.element_at(words, -1), k + 1) for k in range(longer)]
    return F.concat_ws(" ", title, F.array_join(front, " ") if not more else F.array_join(F.concat(front, F.array(*more)), " "), last)


def _of(names: tuple[str, ...], seed: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (_drawn(seed, F.lit(17), len(names)) + 1).cast("int"))


def surrogate(entity: Column, kind: Column, last: Column, key: str, attempt: Column, longer: int = 0) -> Column:
    """``last`` is the surrogate of a name's last word; null for other kinds."""
    seed = F.concat_ws("|", F.lit(key), kind, entity, attempt.cast("string"))
    # A name of one word has no words before the last: its two blanks become one.
    return (
        F.when(kind == "email", _email(entity, seed, longer)).when(kind == "ip", _ip(seed)).when(kind == "card", _card(entity, seed))
        .when(kind == "phone", _phone(entity, seed, longer)).when(kind == "last", _last(entity, seed, longer))
        .otherwise(F.regexp_replace(_name(entity, last, key, attempt, longer), "  ", " "))
    )


def _settled(known: DataFrame, key: str) -> DataFrame:
    """(entity, kind, last, surrogate) of stored, distinct (entity, kind, last): distinct, and none equal to an entity."""
    names = known.select(F.col("entity").alias("surrogate"))
    done, todo, attempt, longer, left = None, known, 0, 0, None
    while True:
        drawn = stored(todo.withColumn("surrogate", surrogate(F.col("entity"), F.col("kind"), F.col("last"), key, F.lit(attempt), longer)), "drawn")
        owners = drawn.groupBy("surrogate").agg(F.min("entity").alias("owner")).join(names, "surrogate", "left_anti")
        if done is not None:
            owners = owners.join(done.select("surrogate"), "surrogate", "left_anti")
        fine = drawn.join(owners, (drawn.surrogate == owners.surrogate) & (drawn.entity == owners.owner), "left_semi")
        fine = stored(fine, "surrogates")
        done = fine if done is None else done.unionByName(fine)
        todo = stored(drawn.join(fine.select("entity"), "entity", "left_anti").select("entity", "kind", "last"), "again")
        before, left = left, todo.count()
        if not left:
            return done
        attempt += 1
        longer += attempt >= ROUNDS or left == before


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(entity, kind, surrogate) of distinct ``entities`` (entity): distinct, and none equal to an entity."""
    known = stored(entities.where("entity IS NOT NULL").select("entity").distinct().withColumn("kind", kind_of(F.col("entity"))), "entities")
    known = known.withColumn("word", F.when(F.col("kind") == "name", F.element_at(_words(F.col("entity")), -1)))
    words = known.where("word IS NOT NULL").select(F.col("word").alias("entity")).distinct()
    lasts = _settled(stored(words.select("entity", F.lit("last").alias("kind"), F.lit(None).cast("string").alias("last")), "last"), key)
    known = known.join(lasts.select(F.col("entity").alias("word"), F.col("surrogate").alias("last")), "word", "left").select("entity", "kind", "last")
    return _settled(stored(known, "known"), key).select("entity", "kind", "surrogate")


def replaced(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """(row, text, entities, surrogates): every row with its text after replacement and what was replaced by what, in order."""
    # The patterns run over all texts once, and what they find is stored beside the rows.
    entities = F.coalesce(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(ANY), F.lit(0)), F.array().cast("array<string>"))
    rows = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), entities.alias("e")), "scanned")
    rows = rows.withColumn("t", F.col("row")[text])
    hit = rows.where(F.size("e") > 0).select("row", "t", "e", F.xxhash64("t").alias("k1"), F.xxhash64(F.lit(1), "t").alias("k2"))
    found = stored(hit.groupBy("k1", "k2").agg(F.min("e").alias("e")), "found")
    table_ = surrogates(found.select(F.explode(F.array_distinct("e")).alias("entity")), key).select("entity", "surrogate")
    each = found.select("k1", "k2", F.posexplode("e").alias("i", "entity")).join(table_, "entity")
    lists = each.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("i", "entity", "surrogate"))).alias("e"))
    pieces = F.split("t", ANY)
    new = F.array_join(F.zip_with(pieces, "e.surrogate", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = hit.drop("e").join(lists, ["k1", "k2"]).select("row", new.alias("text"), F.col("e.entity").alias("entities"), F.col("e.surrogate").alias("surrogates"))
    none = F.array().cast("array<string>")
    return changed.unionByName(rows.where(F.size("e") == 0).select("row", F.col("t").alias("text"), none.alias("entities"), none.alias("surrogates")))


def without_private_data(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with its own columns, the text after replacement."""
    return replaced(docs, text, key).select(F.col("row").withField(f"`{text}`", F.col("text")).alias("row")).select("row.*")


def op4(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_entities, n_distinct, entities, surrogates, text) of every document."""
    out = replaced(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "row.doc_id", F.size("entities").cast("long").alias("n_entities"), F.size(F.array_distinct("entities")).cast("long").alias("n_distinct"),
        "entities", "surrogates", "text",
    )
