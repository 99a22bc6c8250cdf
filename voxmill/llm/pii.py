"""Personal data replaced by surrogates: DataFrame and SQL functions alone.

Detected are e-mail addresses, IP addresses, payment cards (a known issuer's first digits and a right check digit), phone
and social security numbers, IBANs, secret tokens, and names (a title or a listed given name, then a family name; or what
a phrase such as "my name is" introduces).  A family name so found is also found where it stands alone in the same text.

An entity's surrogate is drawn from a keyed digest of its canonical form, so it is the same everywhere, however it is
written, and nobody without the key can go back.  Digits stand for digits, letters for letters of the same script and
case, marks stay where they are; cards keep the issuer and get a right check digit, addresses keep their top domain, and
octets their width.  Of a name, the title stays, the given name becomes another one of its script and gender (a keyed
rotation of the list, so distinct ones stay distinct), and the family name is drawn by itself: Mrs Mary Smith, Mary Smith,
MRS. SMITH and Smith keep their family name in common, and a Cyrillic feminine form is one of the masculine surrogate.

Distinct entities are checked over the whole corpus: of those whose surrogates are equal, and those whose surrogate is
an entity of the corpus, all but the first draw again, until none is left.  Formats get more room with every second draw,
those with few surrogates from the third draw on (names get further syllables, e-mail addresses further letters, numbers
that begin with + further pairs of digits, octets any width), all others from the ninth on (further digits or letters).
From draw STRICT on a surrogate may be an entity of the corpus, but never that of another; after LAST draws, which the
room makes impossible but for addresses of four octets, the job fails rather than return equal surrogates.

The texts are matched once: a table keeps them in pieces, between and in matches.  What had to draw again is a small table
that is joined by the row's number in that table, for rows with entities alone; no other row is shuffled.

Defined results: a null text stays null and an empty one empty; digits that fail a card's check stay; a text may be of any
length, while an entity is bounded by its pattern; repeated rows get the same text; other columns pass unchanged, whatever
their names, but for one named `n_entities`, which is replaced; an empty table has no rows.  Given names beyond the list
are found after an introduction alone, and two of them may share a surrogate; scripts but Latin, Cyrillic and Greek get Latin family names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.llm._store import cut

#: Draws from the format alone, and then for each step by which it gets wider; steps before numbers of fixed length do.
_NARROW, _FIXED = 2, 4
STRICT, LAST = 32, 64
# Given names by script and gender, family name syllables, titles by gender.
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Thomas Daniel Peter Paul Hans Karl Jean Pierre Luis Carlos Richard Joseph Charles Mark Steven George Kevin Brian Edward Anthony Jürgen Klaus Stefan Jacques Miguel Javier João Marco Giovanni".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Susan Sarah Karen Emma Laura Ingrid Greta Claire Sophie Carmen Lucía Barbara Jessica Nancy Lisa Margaret Sandra Ashley Emily Michelle Ursula Monika Sabine Camille Isabel Ana Giulia".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил Владимир Павел Виктор Юрий".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Людмила Галина Юлия".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Δημήτρης Παναγιώτης Χρήστος".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Βασιλική Αναστασία".split(),
}
FAMILY = {
    "latin": ("Bar Cal Dor Fen Gar Hal Ker Lan Mor Nor Pel Ros Sal Tor Var Wil".split(), "ba de ki lo ma ne ri so".split(), "ck dale field ford ham lin man ner nik ras son stein ton vel well wick".split()),
    "cyrillic": ("Бар Вол Гор Дан Зар Кор Лан Мор Нор Пел Рос Сав Тар Фед Чер Яр".split(), "ба ве ди ко ла ми но ри".split(), "бов вин дов лев лин ков лов мин нов ров сков тов дин чев шин нин".split()),
    "greek": ("Βαρ Γαλ Δορ Ζερ Καλ Λαν Μαρ Νικ Παν Ροδ Σαλ Ταρ Φιλ Χαρ Μελ Θεο".split(), "βα δε κι λο μα νε ρι σο".split(), "δης κος λας νης ρας τος πουλος ιδης ακης νος λης κης μης ρος της σας".split()),
}
TITLES = {"m": "Mr Herr Señor Sr".split(), "f": "Mrs Ms Miss Frau Mme Mlle Señora Sra".split(), "": "Dr Prof".split()}

_ALL_GIVEN = [name for names in GIVEN.values() for name in names]
_LATIN = [*GIVEN["latin", "m"], *GIVEN["latin", "f"]]
_W = r"[\p{L}\p{N}]"
_CAPITAL = r"\p{Lu}\p{L}{1,40}(?:['’-]\p{Lu}\p{L}{1,40})?"
_INTRODUCED = r"(?<=[Nn]ame is |[Nn]ame: |[Ss]igned by |[Ss]incerely, )"
_ALTERNATIVES = [
    rf"(?=[{_W[1:-1]}_%+-])[{_W[1:-1]}_%+-][{_W[1:-1]}._%+-]{{0,63}}+@[{_W[1:-1]}-]{{1,63}}(?:\.[{_W[1:-1]}-]{{1,63}}){{0,6}}\.\p{{L}}{{2,24}}",
    rf"(?=\p{{Lu}})(?:(?:{'|'.join(t for ts in TITLES.values() for t in ts)})\.? (?:(?:{'|'.join(_ALL_GIVEN)}) )?|(?:{'|'.join(_ALL_GIVEN)}) |{_INTRODUCED}(?:\p{{Lu}}\p{{L}}{{1,40}} )?){_CAPITAL}(?!{_W})",
    r"(?=[0-9A-Fa-f])(?<!:)(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![:\p{L}\p{N}])",
    rf"(?=[0-9A-Fags])(?:[0-9a-f]{{32,128}}|[0-9A-F]{{32,128}}|AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{36}}|sk-[A-Za-z0-9]{{20,64}})(?!{_W})",
    rf"(?=\d)\d{{3}}-\d{{2}}-\d{{4}}(?!{_W}|-\d)",
    rf"(?=[+(\d])(?<!\+)(?:\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:[ .-]?\d{{2,4}}){{1,4}}|\(\d{{3}}\) ?\d{{3}}[ .-]\d{{4}}|\d{{3}}-\d{{3}}-\d{{4}})(?!{_W}|-\d)",
    rf"(?=\d)(?<![.-])(?!(?:\d{{1,3}}\.){{3}})\d(?:[ -]?\d){{12,18}}(?!{_W}|-\d)",
    rf"(?=[A-Z])[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?(?!{_W})",
]
#: No match begins inside a word, but for addresses of four octets: that is looked at first, once for all kinds.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERN = rf"(?<!{_W})(?:{'|'.join(_ALTERNATIVES)})|(?=\d)(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)"
#: Signs that stand for nothing in any text; round what matches.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"

_LETTERS = (("abcdefghijklmnopqrstuvwxyz", "a-z"), ("абвгдежзиклмнопрстуфхцчшщыэюя", "а-яё"), ("αβγδεζηθικλμνξοπρστυφχψω", "α-ωάέήίόύώ"))
_FEMININE = "(?i)(ов|ев|ёв|ин)а$"


def _let(x: Column, use) -> Column:
    """use(x), with x worked out once."""
    return F.get(F.transform(F.array(x), use), 0)


def _kind(e: Column) -> Column:
    tests = {
        "email": e.contains("@"), "ip": e.rlike(r"^\d+(\.\d+){3}$"), "ip6": e.contains(":"),
        "secret": e.rlike("^([0-9a-f]{32,}|[0-9A-F]{32,}|AKIA.*|gh[pousr]_.*|sk-.*)$"),
        "ssn": e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "phone": e.rlike(r"^([+(].*|\d{3}-\d{3}-\d{4})$"), "card": e.rlike("^[0-9]"), "iban": e.rlike(r"^[A-Z]{2}\d"),
    }
    out = F.lit("name")
    for kind, test in reversed(tests.items()):
        out = F.when(test, kind).otherwise(out)
    return out


def _family(e: Column) -> Column:
    """The family name of a name: its last word."""
    return F.substring_index(e, " ", -1)


def _canonical(e: Column, kind: Column) -> Column:
    """What all ways to write an entity have in common; of a name, that is its family name in the masculine."""
    bare = F.regexp_replace(F.lower(e), r"[^\p{L}\p{N}]", "")
    family = F.lower(F.regexp_replace(_family(e), _FEMININE, "$1"))
    return F.when(kind == "secret", e).when(kind == "name", family).when(kind.isin("email", "ip", "ip6"), F.lower(e)).otherwise(bare)


def _check_sum(digits: Column, shift: int) -> Column:
    """The Luhn sum; shift 1 leaves room for a check digit."""
    value = lambda d, i: F.when((i + shift) % 2 == 0, d.cast("int")).when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int"))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, d: a + d)


def pieces(text: Column) -> Column:
    """The text in pieces: every second one, from the second on, is a match.  One pass with the pattern."""
    marks = f"[{_OPEN}{_CLOSE}]"
    marked = lambda x, pattern: F.split(F.regexp_replace(x, pattern, F.lit(f"{_OPEN}$0{_CLOSE}")), marks, -1)
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    apart = F.flatten(F.zip_with(F.split(text, PATTERN, -1), found, lambda p, e: F.when(e.isNull(), F.array(p)).otherwise(F.array(p, e))))
    is_match = lambda _, i: i % 2 == 1
    families = lambda ps: F.array_distinct(F.transform(F.filter(F.filter(ps, is_match), lambda e: _kind(e) == "name"), _family))

    def with_bare_names(x: Column) -> Column:
        alone = F.concat(F.lit(f"(?<!{_W})(?:"), F.array_join(F.array_union(x.families, F.transform(x.families, F.upper)), "|"), F.lit(f")(?!{_W})"))
        more = F.flatten(F.transform(x.ps, lambda p, i: F.when(i % 2 == 1, F.array(p)).otherwise(marked(p, alone))))
        return F.when(F.size(x.families) > 0, more).otherwise(x.ps)

    once = _let(marked(text, F.lit(PATTERN)), lambda ps: F.when(F.size(ps) < 2, ps).otherwise(_let(F.struct(ps.alias("ps"), families(ps).alias("families")), with_bare_names)))
    return F.when(text.rlike(marks), apart).otherwise(once)


def entities(parts: Column) -> Column:
    """array<struct<e, k, c>>: each match with its kind (none: digits that are no card) and canonical form."""
    found = F.transform(F.filter(parts, lambda _, i: i % 2 == 1), lambda e: F.struct(e.alias("e"), _kind(e).alias("k")))
    formed = F.transform(found, lambda v: F.struct(v.e.alias("e"), v.k.alias("k"), _canonical(v.e, v.k).alias("c")))
    issuer = "^(4|5[1-5]|2(22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|6)"
    false = lambda v: (v.k == "card") & ~(v.c.rlike(issuer) & (_check_sum(v.c, 0) % 10 == 0))
    return F.transform(formed, lambda v: F.struct(v.e.alias("e"), F.when(false(v), "none").otherwise(v.k).alias("k"), v.c.alias("c")))


def _steps(again: Column) -> Column:
    """How often a format gets wider for an entity that has drawn `again` times before."""
    return F.floor(again / _NARROW).cast("int")


def _draws(v: Column, again: Column, secret: str) -> Column:
    """Numbers 0 to 65535 from the keyed digest of a canonical form, one for each of its signs at least."""
    blocks = F.sequence(F.lit(0), F.floor((F.length(v.c) + 2 * _steps(again)) / 16).cast("int"))
    digests = F.transform(blocks, lambda b: F.sha2(F.concat_ws("|", F.lit(secret), v.k, v.c, again.cast("string"), b.cast("string"), F.lit(secret)), 256))
    places = F.sequence(F.lit(0), F.lit(15))
    return F.flatten(F.transform(digests, lambda h: F.transform(places, lambda j: F.conv(F.substring(h, j * 4 + 1, F.lit(4)), 16, 10).cast("int"))))


def _poured(s: Column) -> Column:
    """Digits and letters of s.e replaced by drawn ones of their class, from sign s.a (of all) on and before sign s.b."""
    drawn = lambda a: F.get(s.d, a.n % F.size(s.d))

    def sign(a: Column, x: Column) -> Column:
        out = F.when((a.i < s.a) | (a.i >= s.b), x).when(x.rlike("[0-9]"), (drawn(a) % 10).cast("string"))
        for letters, span in _LETTERS:
            many = F.when(s.hex, 6).otherwise(len(letters)) if span == "a-z" else F.lit(len(letters))
            new = F.substring(F.lit(letters), (drawn(a) % many + 1).cast("int"), F.lit(1))
            out = out.when(x.rlike(f"[{span}]"), new).when(F.lower(x).rlike(f"[{span}]"), F.upper(new))
        return out.when(x.rlike(r"\p{L}"), F.substring(F.lit(_LETTERS[0][0]), (drawn(a) % 26 + 1).cast("int"), F.lit(1))).otherwise(x)

    step = lambda a, x: F.struct(F.concat(a.out, sign(a, x)).alias("out"), (a.n + F.when(x.rlike(r"[\p{L}\p{N}]"), 1).otherwise(0)).alias("n"), (a.i + 1).alias("i"))
    return F.aggregate(F.split(s.e, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("n"), F.lit(0).alias("i")), step, lambda a: a.out)


def _widened(s: Column) -> Column:
    """Poured, with s.w times as much room: a letter more before the @, two digits more after other things, or letters."""
    last = lambda j: F.get(s.d, F.size(s.d) - 1 - j % F.size(s.d))
    letter = lambda j: F.substring(F.lit(_LETTERS[0][0]), (last(j) % F.when(s.hex, 6).otherwise(26) + 1).cast("int"), F.lit(1))
    digits = lambda j: F.lpad((last(j) % 100).cast("string"), 2, "0")
    early = (s.k == "email") | ((s.k == "phone") & s.e.startswith("+"))
    steps = F.sequence(F.lit(1), F.when(early, s.w).otherwise(F.greatest(s.w - _FIXED + 1, F.lit(1))))
    more = F.array_join(F.transform(steps, lambda j: F.when(s.k.isin("email", "secret", "ip6"), letter(j - 1)).otherwise(digits(j - 1))), "")
    wide = F.when(s.k == "email", F.concat(F.substring_index(s.p, "@", 1), more, F.lit("@"), F.substring_index(s.p, "@", -1))).otherwise(F.concat(s.p, more))
    return F.when(F.when(early, s.w > 0).otherwise(s.w >= _FIXED), wide).otherwise(s.p)


def _octets(s: Column) -> Column:
    other = lambda o, i: F.when(s.w > 0, F.get(s.d, i) % 256).when(F.length(o) == 1, F.get(s.d, i) % 10).when(F.length(o) == 2, 10 + F.get(s.d, i) % 90).otherwise(100 + F.get(s.d, i) % 156)
    return F.array_join(F.transform(F.split(s.e, r"\."), lambda o, i: other(o, i).cast("string")), ".")


def _checked(s: Column) -> Column:
    """A card number whose last digit is right; late draws put digits in before it."""
    digits = lambda j: F.lpad((F.get(s.d, F.size(s.d) - j % F.size(s.d)) % 100).cast("string"), 2, "0")
    more = F.when(s.w >= _FIXED, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(s.w - _FIXED + 1, F.lit(1))), digits), "")).otherwise("")
    digit = lambda t: ((10 - _check_sum(F.regexp_replace(t, "[^0-9]", ""), 1) % 10) % 10).cast("string")
    return _let(F.concat(F.regexp_replace(s.p, "[0-9]$", ""), more), lambda t: F.concat(t, digit(t)))


def _rotation(secret: str) -> dict[str, str]:
    """Each listed given name's surrogate: the next one of its list in the order of a keyed digest."""
    out = {}
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{secret}|given|{n}|{secret}".encode()).digest())
        out |= dict(zip(order, [*order[1:], order[0]], strict=True))
    return out


def _name(s: Column, secret: str) -> Column:
    """The title stays; a given name has another of its list, a family name one made of syllables of its script."""
    at_place = lambda at: F.get(s.d, (F.lit(at) if isinstance(at, int) else at) % F.size(s.d))
    pick = lambda names, at: F.get(F.array(*map(F.lit, names)), at_place(at) % len(names))
    more = lambda part: F.array_join(F.transform(F.sequence(F.lit(0), s.w), lambda j: F.when(j > 0, pick(part, j + 4)).otherwise(pick(part, 1))), "")
    family = lambda parts: F.concat(pick(parts[0], 0), more(parts[1]), pick(parts[2], 2))
    of = _family(s.e)
    made = F.when(of.rlike(r"\p{IsCyrillic}"), F.concat(family(FAMILY["cyrillic"]), F.when(of.rlike(_FEMININE), "а").otherwise("")))
    made = made.when(of.rlike(r"\p{IsGreek}"), family(FAMILY["greek"])).otherwise(family(FAMILY["latin"]))
    given = F.create_map(*(F.lit(x) for pair in _rotation(secret).items() for x in pair))
    last = F.size(F.split(s.e, " ")) - 1
    cased = lambda x: _let(made, lambda m: F.when((F.length(x) > 1) & (x == F.upper(x)), F.upper(m)).otherwise(m))
    titled = F.regexp_replace(s.e, " .*", "").rlike(rf"^(?:{'|'.join(t for ts in TITLES.values() for t in ts)})\.?$")
    other = lambda x: F.get(F.array(*map(F.lit, _LATIN)), F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(f"{secret}|given|"), F.lower(x), F.lit(f"|{secret}")), 256), 1, 6), 16, 10).cast("int"), F.lit(len(_LATIN))))
    return F.array_join(F.transform(F.split(s.e, " "), lambda x, i: F.when(i == last, cased(x)).when((i == 0) & titled, x).otherwise(F.coalesce(F.try_element_at(given, x), other(x)))), " ")


def surrogates(found: Column, again, secret: str) -> Column:
    """What stands for each of `entities`; again(v) says how often an entity has drawn before."""
    drawn = F.transform(found, lambda v: F.struct(v.e.alias("e"), v.k.alias("k"), _draws(v, again(v), secret).alias("d"), _steps(again(v)).alias("w")))
    length = lambda pattern: lambda v: F.length(F.regexp_extract(v.e, pattern, 0))
    after = {"phone": length(r"^\+[0-9]{1,3}(?=[ .(-])|^\+[0-9]"), "secret": length("^(AKIA|gh[pousr]_|sk-)"), "card": lambda v: F.lit(1), "iban": lambda v: F.lit(2)}

    def bounds(v: Column) -> Column:
        start = F.lit(0)
        for kind, of in after.items():
            start = F.when(v.k == kind, of(v)).otherwise(start)
        end = F.when(v.k == "email", F.length(v.e) - length(r"\.[^.@]+$")(v)).otherwise(F.length(v.e))
        return F.struct(v.e.alias("e"), v.k.alias("k"), v.d.alias("d"), v.w.alias("w"), start.alias("a"), end.alias("b"), v.e.rlike("^[0-9a-fA-F:]+$").alias("hex"))

    made = lambda s: F.when(s.k == "none", s.e).when(s.k == "ip", _octets(s)).when(s.k == "card", _checked(s)).when(s.k == "name", _name(s, secret)).otherwise(_widened(s))
    poured = lambda s: F.struct(*(s[c].alias(c) for c in ("e", "k", "d", "w", "hex")), F.when(~s.k.isin("none", "ip", "name"), _poured(s)).alias("p"))
    return F.transform(F.transform(F.transform(drawn, bounds), poured), made)


def draw_again(found: DataFrame, secret: str) -> DataFrame | None:
    """(k, c, n): of entities (k, c, e), those that had to draw n more times until all surrogates differ from each other
    and from entities."""
    # One spelling stands for all: forms of one entity have the same digits and letters.
    known = cut(found.where("k <> 'none'").groupBy("k", "c").agg(F.min("e").alias("e")), "entities")
    taken = known.select("k", F.col("c").alias("s"), F.lit(True).alias("taken"))
    waiting, settled = known.withColumn("n", F.lit(0)), None
    for draw in range(LAST):
        one = surrogates(F.array(F.struct("e", "k", "c")), lambda v: F.col("n"), secret)
        drawn = waiting.withColumn("s", _let(F.struct(F.get(one, 0).alias("e"), F.col("k").alias("k")), lambda v: _canonical(v.e, v.k)))
        fine = F.row_number().over(Window.partitionBy("k", "s").orderBy("c")) == 1
        drawn = drawn.withColumn("fine", fine)
        for other in ([taken] if draw < STRICT else []) + ([settled.select("k", "s", F.lit(True).alias("taken"))] if settled is not None else []):
            drawn = drawn.join(other, ["k", "s"], "left").withColumn("fine", F.col("fine") & F.col("taken").isNull()).drop("taken")
        drawn = cut(drawn, "drawn")
        settled = drawn.where("fine") if settled is None else settled.unionByName(drawn.where("fine"))
        waiting = drawn.where("not fine").select("k", "c", "e", (F.col("n") + 1).alias("n"))
        if waiting.isEmpty():
            return settled.where("n > 0").select("k", "c", "n") if draw else None
    raise RuntimeError("a format has too few surrogates for the entities of this corpus")


def pseudonymise(docs: DataFrame, secret: str, text_column: str = "text") -> DataFrame:
    """docs with surrogates in its text, and n_entities, how many were replaced.  Keep the secret: it alone leads back."""
    if not secret:
        raise ValueError("surrogates need a key")
    others = [c for c in docs.columns if c not in (text_column, "n_entities")]
    # Columns of the input live in a struct, where their names meet none of ours.
    held = F.struct(*(F.col(f"`{c}`") for c in others), F.lit(0).alias("")) if others else F.struct(F.lit(0).alias(""))
    rows = docs.select(held.alias("row"), pieces(F.col(f"`{text_column}`").cast("string")).alias("pieces"))
    rows = cut(rows.withColumns({"matches": F.floor(F.size("pieces") / 2).cast("int"), "number": F.monotonically_increasing_id()}), "pieces")
    held = rows.where("matches > 0")
    each = held.select("number", F.explode(entities(F.col("pieces"))).alias("v")).select("number", "v.*")
    moved = draw_again(each.select("k", "c", "e"), secret)
    with_surrogates, plain, again = rows, None, lambda v: F.lit(0)
    if moved is not None:
        counts = each.select("number", "k", "c").distinct().join(moved, ["k", "c"]).groupBy("number").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "k", "c"), "n"))).alias("again"))
        with_surrogates, plain = held.join(counts, "number", "left"), rows.where("matches <= 0 or matches is null")
        again = lambda v: F.coalesce(F.try_element_at("again", F.concat_ws("|", v.k, v.c)), F.lit(0))
    found = F.when(F.col("matches") > 0, entities(F.col("pieces")))
    with_surrogates = with_surrogates.withColumn("found", found).withColumn("new", F.when(F.col("matches") > 0, surrogates(F.col("found"), again, secret)))
    joined = F.array_join(F.transform("pieces", lambda p, i: F.when(i % 2 == 1, F.get("new", F.floor(i / 2).cast("int"))).otherwise(p)), "")
    count = F.coalesce(F.size(F.filter("found", lambda v: v.k != "none")), F.lit(0))
    out = lambda df, text, n: df.select(*(text.alias(c) if c == text_column else F.col("row").getField(c).alias(c) for c in docs.columns if c != "n_entities"), n.alias("n_entities"))
    whole = F.array_join("pieces", "")
    told = out(with_surrogates, F.when(F.col("matches") > 0, joined).otherwise(whole), F.when(F.col("matches") > 0, count).otherwise(0))
    return told if plain is None else told.unionAll(out(plain, whole, F.lit(0)))
