"""Surrogates for personal data, in DataFrame operations only.

Entities are found by patterns. Each distinct entity of the corpus gets one
replacement of its own kind, drawn by a keyed hash (HMAC-SHA-256): letters stay
letters of the same script and case, digits stay digits, card numbers pass the
check sum, hosts, phone and social security numbers move to ranges that nobody has,
mail addresses to reserved domains, one for each domain. A replacement that another
entity has got too, or that occurs in the corpus itself, is drawn anew, so distinct
entities stay distinct, and one entity has the same replacement wherever and however
it is written. The supply grows with the draw, so no number of entities uses it up.

Names are replaced by words: each given name and each family name of the corpus has
one replacement of its own. So people who share a family name still do and others
don't, ``Mr John Smith`` and ``Mrs Smith`` stay two, and a part of a name is the part
of its replacement. A name is found by a title; where its document repeats it or a
part of it, with another title or none, it is replaced as well. Given names follow the gender that titles tell
in the corpus, and all names the script they are written in. Particles (de, von) stay.
Words that open sentences (``However``) end a name; a word that is also a common one, by
a short list or because its document has it in lower case, is a name only
under a title or within a sentence.

Who knows the key can try out which original a replacement may stand for, so there
is no default: keep it secret, or draw a fresh one and throw it away.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywright.llm.common import cut

#: Draws after which a collision must be a fault.
MOST_DRAWS = 64

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_LEFT = r"(?<![\p{L}\p{N}])"
#: Titles that tell a gender (fixed values), and those that tell none.
TITLES = {
    "m": ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Signor", "г-н", "Господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Sra", "Madame", "Mme", "Mlle", "Signora", "г-жа", "Госпожа"),
    "n": ("Dr", "Prof", "Professor", "Mx"),
}
#: Words within names that stay as they are (fixed values).
PARTICLES = "af al av ben bin da das de del della den der di do dos du e el ibn la las le los ter ten van von y zu zum zur".split()
#: Words that are written large where sentences begin and are no names (fixed values).
OPENERS = (
    "a about after again all also although an and another any as at because before both but by each even every finally first for from he her here his how however i if in indeed instead it its later many meanwhile moreover most my nevertheless no nor not now "
    "of on once one or other our over perhaps she since so some soon still such that the their then there therefore these they this those though thus to today tomorrow under until we what when where which while who why with without yes yesterday yet you your "
    "aber als auch auf bei bis das dann denn dennoch die dies diese doch durch ein eine er es gestern heute hier ich ihr im in jedoch jetzt mit morgen nach nein nicht noch nun oder ohne schon sie so und unter vor wann warum was weil wenn wer wie wir wo zu "
    "ainsi alors après aussi aujourd'hui avant avec car ce ces cette comme dans donc elle elles en encore enfin et hier ici il ils je les lorsque mais non nous on où oui par parfois plus pour pourquoi puis quand que qui sans si sous sur tu un une vous "
    "ahora al antes aquí así aunque ayer como con cuando después donde él ella ellas ellos en entonces es ese esta este hoy luego más mientras muy nosotros nunca o para pero por porque qué quién según sin sobre también una uno usted"
).split()
#: Family names that are common words as well (fixed values).
COMMON = (
    "angel baker ball banks bell best bird bishop black blue bright brown church cook cross day fair field fox gold good grace grant gray green grey hall hill hope joy justice king knight lake law little long lord love mark mason may mayor moody page park "
    "pope power price prince rich rivers rose sharp short silver small smart stone strong summers sweet swift turner wall wells west white wild winter wise wolf wood woods young alt gross klein kurz lang neu schwarz weiss grand petit blanc noir bueno bravo rico rubio"
).split()
_TITLE = "|".join(sorted((t for v in TITLES.values() for t in v), key=len, reverse=True))
_WITHIN = rf"(?:(?:{'|'.join(p for p in PARTICLES if len(p) > 1)}) ){{0,3}}"
#: Kind and pattern, in the order in which they are tried at a place.
PATTERNS = (
    ("email", r"(?<![\p{L}\p{N}._%+\-@])[\p{L}\p{N}_%+\-]++(?:\.[\p{L}\p{N}_%+\-]+)*+@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]+)*\.\p{L}{2,}"),
    ("secret", r"(?i:(?<![\p{L}\p{N}])(?:token|api[_\-]?key|secret)\s{0,3}[=:]\s{0,3}[\"']?)(?-i:[A-Za-z0-9_\-+/]{12,})|(?i:(?<![\p{L}\p{N}])(?:password|passwd)\s{0,3}[=:]\s{0,3}[\"']?)(?:[^\s\"']*[^\s\"'.,;)\]}]|[^\s\"']+)"),
    ("ip6", r"(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])"),
    ("ip", r"(?<![\d.])" + rf"(?:{_OCTET}\.){{3}}{_OCTET}" + r"(?!\.?\d)"),
    ("ssn", _LEFT + r"\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])"),
    ("phone", r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\p{L}\p{N}])"),
    ("card", r"(?<![\p{L}\p{N}])\d(?:[ \-]?\d){12,18}(?![\p{L}\p{N}])"),
    ("person", rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.?[ ](?:{_WITHIN}\p{{Lu}}[\p{{L}}'’\-]+(?: {_WITHIN}\p{{Lu}}[\p{{L}}'’\-]+){{0,2}}|[\p{{Lo}}\p{{IsGeorgian}}][\p{{L}}\p{{M}}]+)|(?<![\p{{L}}\p{{N}}])(?:mr|mrs)\.? \p{{Ll}}[\p{{L}}'’\-]+"),
)
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: What a text with an entity must have.
HINT = rf"[\d@]|[=:]|(?:{_TITLE}|mrs?)\.? "
#: Kinds of which names are made; ``person`` is a whole one of a script without spaces.
NAMES = ("given", "family", "person")
_SECRET_HEAD = r"(?i)^(?:token|api[_\-]?key|secret|password|passwd)\s{0,3}[=:]\s{0,3}[\"']?"
_TITLE_HEAD = rf"^(?:{_TITLE}|mrs?)\.? "

#: Country codes of phone numbers (fixed values): one or two digits, else three.
_COUNTRY = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

#: Alphabets by script (fixed values): a letter is replaced by one of its own, the first that knows it. Any other letter becomes a Latin one.
ALPHABETS = (
    ("abcdefghijklmnopqrstuvwxyz", r"^[a-z]$"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"^[A-Z]$"), ("0123456789", r"^\p{N}$"),
    ("àâäáãåçèéêëìíîïñòóôöõùúûüÿß", r"^[\x{DF}-\x{FF}&&\p{L}]$"), ("ÀÂÄÁÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÖÕÙÚÛÜ", r"^[\x{C0}-\x{DE}&&\p{L}]$"),
    ("ąćčďęěłńňőřśšťůűźżžğışțăđ", r"^[\p{IsLatin}&&\p{Ll}]$"), ("ĄĆČĎĘĚŁŃŇŐŘŚŠŤŮŰŹŻŽĞİŞȚĂĐ", r"^[\p{IsLatin}&&\p{Lu}]$"),
    ("абвгдежзиклмнопрстуфхцчшэюя", r"^[\p{IsCyrillic}&&\p{Ll}]$"), ("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", r"^[\p{IsCyrillic}&&\p{Lu}]$"),
    ("αβγδεζηθικλμνξοπρστυφχψω", r"^[\p{IsGreek}&&\p{Ll}]$"), ("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", r"^[\p{IsGreek}&&\p{Lu}]$"),
    ("աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրց", r"^[\p{IsArmenian}&&\p{Ll}]$"), ("ԱԲԳԴԵԶԷԸԹԺԻԼԽԾԿՀՁՂՃՄՅՆՇՈՉՊՋՌՍՎՏՐՑ", r"^[\p{IsArmenian}&&\p{Lu}]$"),
    ("天地玄黄宇宙洪荒日月盈昃辰宿列张", r"^\p{IsHan}$"), ("あいうえおかきくけこさしすせそ", r"^\p{IsHiragana}$"), ("アイウエオカキクケコサシスセソ", r"^\p{IsKatakana}$"),
    ("가나다라마바사아자차카타파하", r"^\p{IsHangul}$"), ("ابتثجحخدذرزسشصضطظعغفقكلمنهوي", r"^\p{IsArabic}$"), ("אבגדהוזחטיכלמנסעפצקרשת", r"^\p{IsHebrew}$"),
    ("กขคงจชซดตทนบปผพมยรลวสหอฮ", r"^\p{IsThai}$"), ("कखगघचछजटडतथदधनपबमयरलवशसह", r"^\p{IsDevanagari}$"), ("აბგდევზთიკლმნოპრსტუფქღშჩცძწჭხჯ", r"^\p{IsGeorgian}$"),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"^\p{Lu}$"), ("abcdefghijklmnopqrstuvwxyz", r"^\p{L}$"),
)
#: Scripts of names, each with what shows it; the first that shows counts, Latin if none does.
SCRIPTS = (
    ("cyrillic", r"\p{IsCyrillic}"), ("greek", r"\p{IsGreek}"), ("armenian", r"\p{IsArmenian}"), ("georgian", r"\p{IsGeorgian}"), ("kana", r"\p{IsHiragana}|\p{IsKatakana}"), ("han", r"\p{IsHan}"),
    ("hangul", r"\p{IsHangul}"), ("arabic", r"\p{IsArabic}"), ("hebrew", r"\p{IsHebrew}"), ("thai", r"\p{IsThai}"), ("devanagari", r"\p{IsDevanagari}"),
)
#: Scripts whose names are written in one piece.
UNSPACED = ("kana", "han", "hangul", "thai")
#: Given names by script and gender, and family names by script (fixed values).
GIVEN = {
    ("latin", "m"): "Adrian Bruno Clemens Dario Emil Fabian Gregor Hugo Ivo Jasper Konrad Lorenz Marius Nils Oscar Paul Quentin Robin Stefan Tobias Viktor Walter",
    ("latin", "f"): "Alma Beatrix Clara Daria Elena Fiona Greta Helena Irma Johanna Katrin Livia Marta Nina Olivia Paula Renata Silvia Teresa Ursula Vera Wanda",
    ("latin", "n"): "Alex Charlie Dominique Eden Frankie Jamie Kim Luca Morgan Noel Quinn Robin Sascha Toni",
    ("cyrillic", "m"): "Андрей Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Леонид Максим Никита Олег Павел Роман Степан Тимур Фёдор",
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Кира Лариса Мария Нина Ольга Полина Раиса Софья Тамара Юлия",
    ("cyrillic", "n"): "Саша Женя Валя Слава Шура",
    ("greek", "m"): "Ανδρέας Γιώργος Νίκος Πέτρος", ("greek", "f"): "Άννα Ελένη Μαρία Σοφία", ("greek", "n"): "Αλέξης Παρασκευάς Χάρις",
    ("armenian", "m"): "Արամ Տիգրան Հայկ", ("armenian", "f"): "Անահիտ Մարիամ Նարե", ("armenian", "n"): "Արշալույս Հրանտ",
    ("georgian", "m"): "გიორგი ლევან ნიკა", ("georgian", "f"): "ანა მარიამ ნინო", ("georgian", "n"): "საბა შოთა",
    ("kana", "m"): "たけし ひろし けんじ", ("kana", "f"): "さくら ゆみこ はなこ", ("kana", "n"): "あおい ひかる", ("han", "m"): "伟 强 军", ("han", "f"): "芳 娜 敏", ("han", "n"): "文 宁",
    ("hangul", "m"): "민준 서준 도윤", ("hangul", "f"): "서연 지우 하은", ("hangul", "n"): "지원 수민", ("arabic", "m"): "أحمد خالد سامي", ("arabic", "f"): "فاطمة ليلى مريم", ("arabic", "n"): "نور صباح",
    ("hebrew", "m"): "דוד יוסף משה", ("hebrew", "f"): "שרה רחל לאה", ("hebrew", "n"): "טל נועם", ("thai", "m"): "สมชาย อนันต์", ("thai", "f"): "มาลี สุดา", ("thai", "n"): "กมล วันดี",
    ("devanagari", "m"): "राम मोहन अमित", ("devanagari", "f"): "सीता राधा नेहा", ("devanagari", "n"): "किरण सुमन",
}
FAMILY = {
    "latin": "Albrecht Barlow Castell Delmar Eriksen Falkner Garland Holloway Isenberg Jarvis Kestrel Lindqvist Marlowe Norwood Ostrander Pellier Quillan Rosgard Sandoval Thornhill Ulrich Valdane Westerly Yardley Zeller",
    "cyrillic": "Белых Грач Дымко Ершенко Живаго Зимних Коваль Лысенко Мороз Нечай Орлик Петренко Рудых Седых Тихих Ушак Чернык Шевчук",
    "greek": "Βλάχος Δημητρίου Καραγιάννης Λάμπρου Μακρής Οικονόμου Σταύρου Φωτίου", "armenian": "Գրիգորյան Հակոբյան Պետրոսյան Սարգսյան", "georgian": "ბერიძე კაპანაძე მაისურაძე ლომიძე",
    "kana": "すずき たなか さとう やまだ", "han": "欧阳 司马 诸葛 上官", "hangul": "남궁 황보 선우 제갈", "arabic": "الحداد النجار الخطيب الصباغ", "hebrew": "כהן לוי מזרחי פרץ", "thai": "ศรีสุข ทองดี ใจงาม", "devanagari": "शर्मा वर्मा गुप्ता",
}


def keyed(message: Column, key: str) -> Column:
    """HMAC-SHA-256 of a text under ``key``, in hex."""
    raw = key.encode()
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def kind_of(entity: Column) -> Column:
    """Which pattern the whole entity is of; null for a run of digits that is no card number."""
    tests = reduce(lambda chain, kp: chain.when(entity.rlike(f"^(?:{kp[1]})$"), F.lit(kp[0])), PATTERNS[1:], F.when(entity.rlike(f"^(?:{PATTERNS[0][1]})$"), F.lit(PATTERNS[0][0])))
    return F.when((tests == "card") & ~luhn_valid(digits(entity)), F.lit(None)).otherwise(tests)


def digits(value: Column) -> Column:
    """The ASCII digits of ``value``."""
    return F.regexp_replace(value, r"[^0-9]", "")


def luhn_sum(number: Column) -> Column:
    """Sum of the digits, every second from the right doubled, as card numbers have it."""
    each = F.filter(F.split(F.reverse(number), ""), lambda c: c != "")
    worth = F.transform(each, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x)


def luhn_valid(number: Column) -> Column:
    """Whether the check digit fits."""
    return luhn_sum(number) % 10 == 0


def _name(entity: Column) -> Column:
    return F.regexp_replace(entity, _TITLE_HEAD, "")


def _own_words(words: Column) -> Column:
    """A name's words but for particles."""
    return F.filter(words, lambda w: ~F.lower(w).isin(*PARTICLES))


def _split(name: Column) -> Column:
    return F.filter(F.split(name, " "), lambda w: w != "")


def bare_name(entity: Column) -> Column:
    """The name under a title: its words up to one that opens sentences."""
    words = _split(_name(entity))
    opener = F.array_position(F.transform(words, lambda w: F.lower(w).isin(*OPENERS) & ~F.lower(w).isin(*PARTICLES)), True)
    return F.array_join(F.when(opener > 0, F.slice(words, F.lit(1), opener.cast("int") - 1)).otherwise(words), " ")


def names_in(text: Column) -> Column:
    """The names that titles tell in ``text``, those of most words first, then as they come."""
    titled = F.filter(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda e: e.rlike(f"^(?:{dict(PATTERNS)['person']})$"))
    names = F.filter(F.array_distinct(F.transform(titled, bare_name)), lambda n: F.size(_own_words(_split(n))) > 0)
    ordered = F.array_sort(F.transform(names, lambda n, i: F.struct((-F.size(_own_words(_split(n)))).alias("words"), i.alias("place"), n.alias("name"))))
    return F.transform(ordered, lambda x: x["name"])


def mentions(names: Column, text: Column) -> Column:
    """The pattern of a document's entities: all kinds, and its names, whole or a word of them, without a title.

    A single word that is a common one too counts only after a word or a comma.
    """
    whole = F.filter(names, lambda n: F.contains(n, F.lit(" ")))
    single = F.array_distinct(F.flatten(F.transform(names, lambda n: F.filter(_own_words(_split(n)), lambda w: F.length(w) > 1))))
    seen = lambda w: (w != F.lower(w)) & F.regexp_like(text, F.concat(F.lit(r"(?<![\p{L}\p{N}])"), F.lower(w), F.lit(r"(?![\p{L}\p{N}])")))
    common = lambda w: F.lower(w).isin(*COMMON) | F.coalesce(seen(w), F.lit(False))

    def pattern(words: Column, before: str) -> Column:
        # A name in small letters is written large elsewhere.
        forms = F.array_distinct(F.concat(words, F.transform(words, F.upper), F.transform(F.filter(words, lambda w: w == F.lower(w)), F.initcap)))
        longest = F.transform(F.array_sort(F.transform(forms, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
        return F.when(F.size(words) > 0, F.concat(F.lit(f"|{before}(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\p{N}])"))).otherwise("")

    free, shy = F.filter(single, lambda w: ~common(w)), F.filter(single, common)
    return F.concat(F.lit(ANY), pattern(F.array_union(whole, free), r"(?<![\p{L}\p{N}])"), pattern(shy, r"(?<=[\p{L}\p{N},;] )"))


_PART = "array<struct<kind:string,canon:string,own:string>>"


def holder(names: Column, entity: Column) -> Column:
    """In lower case, the words of the name that a mention is of, particles left out: its own if it is whole, else those of the document's first name that has its word."""
    own = F.transform(_own_words(_split(bare_name(entity))), F.lower)
    full = F.filter(F.transform(names, lambda n: F.transform(_own_words(_split(n)), F.lower)), lambda n: F.size(n) > 1)
    return F.when(F.size(own) > 1, own).otherwise(F.coalesce(F.get(F.filter(full, lambda n: F.array_contains(n, F.get(own, F.lit(0)))), F.lit(0)), own))


def parts(kind: Column, entity: Column, whole: Column) -> Column:
    """What of an entity is replaced, each for itself: an address by its name and its domain, a person by words, all else as one. Of no kind is what stays."""
    name = bare_name(entity)
    own, last = _split(_name(entity)), F.element_at(whole, -1)
    unspaced = F.size(whole).eqNullSafe(F.lit(1)) & name.rlike("|".join(p for s, p in SCRIPTS if s in UNSPACED))
    inside = F.size(_split(name))
    role = lambda w: F.when(unspaced, "person").when((F.size(whole) > 1) & (F.lower(w) != last), "given").otherwise("family")
    named = F.transform(own, lambda w, i: F.struct(F.when((i < inside) & ~F.lower(w).isin(*PARTICLES), role(w)).alias("kind"), F.lower(w).alias("canon"), w.alias("own")))
    one = lambda k, canon, text: F.struct(k.alias("kind"), canon.alias("canon"), text.alias("own"))
    mail = F.array(one(F.lit("email"), F.lower(entity), F.substring_index(entity, "@", 1)), one(F.lit("domain"), F.lower(F.substring_index(entity, "@", -1)), F.substring_index(entity, "@", -1)))
    return F.when(kind == "email", mail.cast(_PART)).when(kind == "person", named.cast(_PART)).otherwise(F.array(one(kind, canonical(kind, entity), entity)).cast(_PART))


def gender_of(entity: Column) -> Column:
    """m, f or n, by the title."""
    title = F.regexp_extract(entity, _TITLE_HEAD, 0)
    bare = F.regexp_replace(title, r"\.? $", "")
    return F.when(bare.isin(*TITLES["m"], "mr"), "m").when(bare.isin(*TITLES["f"], "mrs"), "f").otherwise("n")


def canonical(kind: Column, entity: Column) -> Column:
    """What tells entities apart: an address in lower case, a number's digits, a secret's value.

    A phone number is its country code and the rest; one without a code has that
    of the numbering plan whose form it has, 1.
    """
    number = digits(entity)
    country = F.when(entity.startswith("+"), F.regexp_extract(number, _COUNTRY, 1)).otherwise("")
    return (
        F.when(kind == "ip6", F.lower(entity))
        .when(kind == "phone", F.concat(F.when(country != "", country).otherwise("1"), F.lit(":"), F.substring(number, F.length(country) + 1, F.length(number))))
        .when(kind.isin("card", "ssn"), number)
        .when(kind == "secret", F.regexp_replace(entity, _SECRET_HEAD, ""))
        .otherwise(entity)
    )


def _drawn(seed: Column, place: Column, among: int) -> Column:
    return F.pmod(F.xxhash64(seed, place), F.lit(among)).cast("int")


def like_letters(value: Column, seed: Column) -> Column:
    """Every letter and digit replaced by one of its own alphabet, the rest kept."""

    def one(c: Column, i: Column) -> Column:
        pick = lambda letters: F.substring(F.lit(letters), _drawn(seed, i, len(letters)) + 1, F.lit(1))
        return reduce(lambda chain, lp: chain.when(c.rlike(lp[1]), pick(lp[0])), ALPHABETS[1:], F.when(c.rlike(ALPHABETS[0][1]), pick(ALPHABETS[0][0]))).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), one), "")


def like_digits(value: Column, seed: Column, kept: int) -> Column:
    """Digits replaced from the place ``kept`` on; the first of them is 2 to 9."""
    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c, i: F.when(i < kept, c).when(i == kept, (_drawn(seed, i, 8) + 2).cast("string")).otherwise(_drawn(seed, i, 10).cast("string"))), "")


def _rest(canon: Column) -> Column:
    """A given name's canonical form without its gender."""
    return F.substring(canon, F.lit(3), F.length(canon))


def _named(seed: Column, kind: Column, canon: Column, draw: Column) -> Column:
    """A given or family name of the script, and of the gender told; later draws have more and more parts. Of a script without spaces, both in one."""
    gender = F.substring(canon, 1, 1)
    script = reduce(lambda chain, sp: chain.when(canon.rlike(sp[1]), sp[0]), SCRIPTS[1:], F.when(canon.rlike(SCRIPTS[0][1]), SCRIPTS[0][0])).otherwise("latin")

    def pick(names: str, place: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, names.split())), _drawn(seed, place, len(names.split())) + 1)

    family = lambda place: F.coalesce(*[F.when(script == s, pick(v, place)) for s, v in FAMILY.items()])
    given = lambda place: F.coalesce(*[F.when((script == s) & (gender == g), pick(v, place)) for (s, g), v in GIVEN.items()])
    many = F.sequence(F.lit(1), F.when(draw < 2, 1).when(draw < 6, 2).otherwise((draw + 6) / 4).cast("int"))
    last, first = F.array_join(F.transform(many, family), "-"), F.array_join(F.transform(many, given), "-")
    return F.when(kind == "given", first).when(kind == "family", last).otherwise(F.concat(F.replace(last, F.lit("-"), F.lit("")), given(F.lit(0))))


def surrogate(kind: Column, canon: Column, draw: Column, key: str) -> Column:
    """The replacement, in canonical form, that the keyed hash draws at the given try.

    Later draws are longer, or from larger ranges, so the supply has no end: only
    social security numbers and cards keep their length, being no more than there
    are numbers.
    """
    seed = keyed(F.concat_ws("\x1f", kind, canon, draw.cast("string")), key)
    longer = lambda value, after: F.concat(value, F.when(draw > after, F.repeat(F.lit("a"), draw - after)).otherwise(""))
    local, host, top = F.regexp_extract(canon, "^([^@]*)@", 1), F.regexp_extract(canon, r"^(.*)\.[^.]+$", 1), F.regexp_extract(canon, r"\.(com|org|net)$", 1)
    reserved = F.concat(like_letters(longer(host, 2), seed), F.lit(".example."), F.when(top != "", top).otherwise("org"))
    octet = lambda i, n, low: (_drawn(seed, F.lit(i), n) + low).cast("string")
    documented = F.concat(F.element_at(F.array(*map(F.lit, ("192.0.2.", "198.51.100.", "203.0.113."))), _drawn(seed, F.lit(0), 3) + 1), octet(3, 254, 1))
    unassigned = F.concat_ws(".", octet(0, 15, 240), octet(1, 256, 0), octet(2, 256, 0), octet(3, 254, 1))
    six = F.concat_ws(":", F.lit("2001:db8"), *[F.lower(F.hex(_drawn(seed, F.lit(10 + i), 65_535) + 1)) for i in range(6)])
    body = F.regexp_replace(like_digits(canon, seed, 1), r".$", "")
    check = (F.lit(10) - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    country, number = F.substring_index(canon, ":", 1), F.substring_index(canon, ":", -1)
    national = F.concat(number, F.when(draw > 8, F.repeat(F.lit("0"), draw - 8)).otherwise(""))
    one = lambda i, n=10, low=0: (_drawn(seed, F.lit(90 + i), n) + low).cast("string")
    # Numbers that nobody has: 555-01xx and area codes with a 9 in the middle, elsewhere two zeros in front.
    american = F.concat(one(0, 8, 2), F.when(draw < 2, F.concat(one(1), one(2), F.lit("55501"), one(3), one(4))).otherwise(F.concat(F.lit("9"), one(1), one(2, 8, 2), *[one(i) for i in range(3, 9)])))
    dialled = F.when((country == "1") & (F.length(number) == 10) & (draw < 24), american).otherwise(F.concat(F.lit("00"), F.substring(like_digits(national, seed, 0), F.lit(3), F.length(national))))
    # Areas 666 and 000, then the group 00, are never given out.
    unissued = F.when(draw < 8, F.concat(F.lit("666"), *[one(i) for i in range(6)])).when(draw < 16, F.concat(F.lit("000"), *[one(i) for i in range(6)])).otherwise(F.concat(one(0, 9), one(1), one(2), F.lit("00"), *[one(i) for i in range(3, 7)]))
    secret = longer(canon, 7)
    hexed = lambda letters: F.array_join(F.transform(F.filter(F.split(secret, ""), lambda c: c != ""), lambda _, i: F.substring(F.lit(letters), _drawn(seed, i, 16) + 1, F.lit(1))), "")
    return (
        F.when(kind == "email", like_letters(longer(local, 2), seed))
        .when(kind == "domain", reserved)
        .when(kind == "phone", F.concat(country, F.lit(":"), dialled))
        .when(kind == "ssn", unissued)
        .when(kind == "card", F.concat(body, check.cast("string")))
        .when((kind == "ip6") | ((kind == "ip") & (draw > 12)), six)
        .when(kind == "ip", F.when(draw < 2, documented).otherwise(unassigned))
        .when(kind == "secret", F.when(canon.rlike("^[0-9a-f]+$"), hexed("0123456789abcdef")).when(canon.rlike("^[0-9A-F]+$"), hexed("0123456789ABCDEF")).otherwise(like_letters(secret, seed)))
        .when(kind.isin(*NAMES), _named(seed, kind, canon, draw))
    )


def rendered(kind: Column, entity: Column, chosen: Column) -> Column:
    """The replacement as the part is written: its case, separators or heading."""
    places = F.filter(F.split(entity, ""), lambda c: c != "")
    # A phone number is written with its country code where the entity has one.
    number = F.when(kind != "phone", chosen).when(entity.startswith("+"), F.replace(chosen, F.lit(":"), F.lit(""))).otherwise(F.substring_index(chosen, ":", -1))
    filled = F.aggregate(
        places, F.struct(F.lit("").alias("out"), F.lit(0).alias("n")),
        lambda a, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(a["out"], F.substring(number, a["n"] + 1, F.lit(1))).alias("out"), (a["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["n"].alias("n"))),
    )["out"]
    filled = F.concat(filled, F.substring(number, F.length(digits(entity)) + 1, F.length(number)))
    lowered, raised = F.lower(entity) == entity, F.upper(entity) == entity
    cased = F.when(raised & ~lowered & (~kind.isin(*NAMES) | (F.length(entity) > 1)), F.upper(chosen)).when(kind.isin("given", "family") & lowered & ~raised, F.lower(chosen)).otherwise(chosen)
    return F.when(kind.isin("phone", "card", "ssn"), filled).when(kind == "secret", F.concat(F.regexp_extract(entity, _SECRET_HEAD, 0), chosen)).otherwise(cased)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """``kind``, ``canon``, ``chosen``: a replacement for each distinct entity, no two the same, none one of the entities.

    Of those that draw the same, the first keeps it and the others draw again,
    as do those that draw what occurs in the corpus.
    """
    everyone = cut(entities.select("kind", "canon").distinct())
    # A given name's canonical form has its gender in front; what may not be drawn is the name. Of an address it is what stands before the domain.
    taken = everyone.select("kind", F.when(F.col("kind").isin("given", "person"), _rest(F.col("canon"))).when(F.col("kind") == "email", F.substring_index("canon", "@", 1)).otherwise(F.col("canon")).alias("chosen_")).distinct()
    settled, open_ = None, everyone.withColumn("draw", F.lit(0))
    for draw in range(MOST_DRAWS):
        drawn = open_.withColumn("chosen", surrogate(F.col("kind"), F.col("canon"), F.col("draw"), key))
        # Compared as the text would show it: names in lower case.
        drawn = drawn.withColumn("chosen_", F.when(F.col("kind").isin(*NAMES), F.lower("chosen")).otherwise(F.col("chosen")))
        used = taken if settled is None else taken.unionByName(settled.select("kind", "chosen_"))
        first = F.row_number().over(Window.partitionBy("kind", "chosen_").orderBy("canon"))
        judged = cut(drawn.withColumn("place", first).join(used.distinct().withColumn("used", F.lit(True)), ["kind", "chosen_"], "left"))
        good = (F.col("place") == 1) & F.col("used").isNull()
        won = judged.filter(good).select("kind", "canon", "chosen", "chosen_")
        settled = won if settled is None else settled.unionByName(won)
        open_ = judged.filter(~good).select("kind", "canon", F.lit(draw + 1).alias("draw"))
        if open_.isEmpty():
            return settled.select("kind", "canon", "chosen")
    raise RuntimeError("replacements keep colliding")


def _genders(once: DataFrame) -> DataFrame:
    """word, gender of the corpus's given names: what their own titles tell, else the titles of the people they belong to; none where these differ."""
    titled = once.filter((F.col("kind") == "person") & F.col("entity").rlike(_TITLE_HEAD)).withColumn("g", gender_of(F.col("entity"))).filter(F.col("g") != "n")
    own = F.filter("parts", lambda p: p["kind"].isin("given", "person"))
    direct = F.transform(own, lambda p: F.struct(p["canon"].alias("word"), F.lit(True).alias("direct")))
    others = F.transform(F.slice("whole", F.lit(1), F.size("whole") - 1), lambda w: F.struct(w.alias("word"), F.lit(False).alias("direct")))
    told = titled.select("g", F.explode(F.when(F.size(direct) > 0, direct).otherwise(others)).alias("w")).select("g", "w.*")
    of = lambda test: F.when(F.min(F.when(test, F.col("g"))) == F.max(F.when(test, F.col("g"))), F.min(F.when(test, F.col("g"))))
    return told.groupBy("word").agg(F.when(F.count_if("direct") > 0, of(F.col("direct"))).otherwise(of(~F.col("direct"))).alias("gender"))


def pseudonymised(docs: DataFrame, key: str, text: str = "text", entities: str = "entities") -> DataFrame:
    """``docs`` with the entities of ``text`` replaced, and ``entities``: the kinds replaced, in order (array<string>).

    Texts without an entity, null and empty ones among them, come through as
    they are with an empty array. Repeated rows get the same replacements, and
    so does any run with the same ``key`` over the same rows. A column named
    ``entities`` is replaced. Texts are searched once to find those that hold
    entities, which are written with what was found in them, and once to pass
    on the others. They meet their replacements by a hash of the text, so that
    copies are worked out once.
    """
    own = F.col(f"`{text}`")
    source = docs.drop(entities)
    hit = F.coalesce(own.rlike(HINT) & own.rlike(ANY), F.lit(False))
    columns = [c for c in docs.columns if c != entities]
    named = source.filter(hit).withColumns({"__hash": F.sha2(own.cast("binary"), 256), "__names": names_in(own)}).withColumn("__any", mentions(F.col("__names"), own))
    held = cut(named.withColumn("__found", F.regexp_extract_all(own, F.col("__any"), F.lit(0))))
    found = held.select("__hash", "__names", F.posexplode("__found").alias("place", "entity"))
    found = found.select("__hash", "place", "entity", holder(F.col("__names"), F.col("entity")).alias("whole"), F.col("entity").rlike(r"^\p{L}").alias("letters"))
    once = found.groupBy("__hash", "place").agg(*[F.first(c).alias(c) for c in ("entity", "whole", "letters")])
    # What is of no kind and no number is a name without its title; a title before nothing but openers is none.
    kind = F.coalesce(kind_of(F.col("entity")), F.when(F.col("letters"), "person"))
    once = cut(once.withColumn("kind", F.when((kind != "person") | (F.size("whole") > 0), kind)).withColumn("parts", parts(F.col("kind"), F.col("entity"), F.col("whole"))))
    spans = once.select("__hash", "place", "entity", F.col("kind").alias("told"), F.posexplode("parts").alias("sub", "p")).select("__hash", "place", "entity", "told", "sub", "p.*")
    resolved = spans.join(_genders(once), F.col("kind").isin("given", "person") & (F.col("canon") == F.col("word")), "left")
    canon = F.when(F.col("kind").isin("given", "person"), F.concat(F.coalesce("gender", F.lit("n")), F.lit(":"), "canon")).otherwise(F.col("canon"))
    spotted = cut(resolved.select("__hash", "place", "entity", "told", "sub", "kind", "own", canon.alias("canon")))
    chosen = cut(assign(spotted.filter(F.col("kind").isNotNull()), key)).withColumnsRenamed({"kind": "kind_", "canon": "canon_"})
    met = spotted.join(chosen, (F.col("kind") == F.col("kind_")) & (F.col("canon") == F.col("canon_")), "left")
    part = F.when(F.col("kind").isNull(), F.col("own")).otherwise(rendered(F.col("kind"), F.col("own"), F.col("chosen")))
    joint = F.when(F.col("told") == "person", " ").when(F.col("told") == "email", "@").otherwise("")
    together = F.call_function("array_join", F.transform(F.sort_array(F.collect_list(F.struct("sub", "part"))), lambda x: x["part"]), F.first("joint"))
    pieces = met.select("__hash", "place", "entity", "told", "sub", part.alias("part"), joint.alias("joint"))
    # By text first: both aggregations then take one shuffle.
    joined = pieces.repartition("__hash").groupBy("__hash", "place").agg(F.first("told").alias("kind"), F.first("entity").alias("entity"), together.alias("made"))
    head = F.when(F.col("kind") == "person", F.regexp_extract("entity", _TITLE_HEAD, 0)).otherwise("")
    written = joined.select("__hash", "place", "kind", F.when(F.col("kind").isNull(), F.col("entity")).otherwise(F.concat(head, "made")).alias("entity"))
    lists = written.groupBy(F.col("__hash").alias("__of")).agg(F.sort_array(F.collect_list(F.struct("place", "entity", "kind"))).alias("__new"))
    between = F.split(own, F.col("__any"), -1)
    mended = F.transform(between, lambda part, i: F.concat(part, F.coalesce(F.get(F.col("__new"), i)["entity"], F.lit(""))))
    replaced = held.join(lists, F.col("__hash") == F.col("__of")).select(*[F.array_join(mended, "").alias(c) if c == text else F.col(f"`{c}`") for c in columns], F.filter(F.col("__new")["kind"], lambda k: k.isNotNull()).alias(entities))
    rest = source.filter(~hit).select(*[F.col(f"`{c}`") for c in columns], F.array().cast("array<string>").alias(entities))
    return replaced.unionByName(rest)
