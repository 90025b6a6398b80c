"""Personal data: detected entities give way to keyed surrogates of the same type, script and format."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from likeness.llm.common import stored, text_key

# The forms in which entities are written.
_ALNUM = r"(?<![\p{L}\p{N}])"
TITLE = ("(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Professor|Doctor|Herr|Herrn|Frau|Monsieur|Madame|Mademoiselle|Mme|Mlle|Señorita|Señora|Señor|Srta|Sra|Sr"
         "|Doktor|Docteur|Doctora|Dra|Profesora|Profesor|Professeur|Господин|Госпожа|Доктор|Профессор)")
PARTICLE = "(?:von|van|vom|zu|zur|zum|der|den|de|del|della|di|da|do|dos|das|du|des|la|las|le|los|el|al|bin|ibn|ter|ten|y|e)"
_WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{L}*\p{Ll}\p{L}*(?:['’]\p{Lu}\p{L}+|-\p{L}+)*"      # Doe, McDoe, O'Doe, Doe-Roe
NAME = rf"(?:(?:\p{{Lu}}\.|{PARTICLE}|{_WORD}) ){{0,5}}?(?:{_WORD})(?: (?:(?:\p{{Lu}}\.|{PARTICLE}) ){{0,3}}{_WORD}){{0,3}}"
PIECE = r"\p{L}+(?:['’]\p{Lu}\p{L}+|-\p{L}+)*|[^\p{L}]+"      # a word, or what stands between words
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])(?=[._%+-]*[\p{L}\p{N}])[\p{L}\p{N}._%+-]++@(?=-*[\p{L}\p{N}])[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "token": _ALNUM + r"(?:(?:sk|pk|ghp|gho|xoxb|xoxp)[-_][A-Za-z0-9_-]{16,}|AKIA[A-Z0-9]{16}|[0-9a-fA-F]{32,128})(?![\p{L}\p{N}])",
    "iban": _ALNUM + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{N}-])",
    "ip": r"(?<![\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\p{N}|\.\p{N})",
    "phone": r"(?<![\p{N}+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4})(?!\p{N})",
    "card": r"(?<!\p{N})\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\p{N})",
    "name": rf"(?<!\p{{L}})(?:{TITLE}\.? )+{NAME}(?!\p{{L}})",
}
FEMALE = r"(?:^| )(?:Mrs|Ms|Miss|Frau|Madame|Mademoiselle|Mme|Mlle|Señorita|Señora|Srta|Sra|Doctora|Dra|Profesora|Госпожа)\.? "
MALE = r"(?:^| )(?:Mr|Herr|Herrn|Monsieur|Señor|Sr|Profesor|Господин)\.? "
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
SYLLABLES = {"latin": "ba de fi go la me ni ro sa te vi lo ka ra mo ne".split(), "cyrillic": "ба де фи го ла ме ни ро са те ви ло ка ра мо не".split()}
ENDINGS = {("latin", "n"): "nel", ("cyrillic", "n"): "нел", ("latin", "m"): "rin", ("latin", "f"): "lia", ("latin", "s"): "ver", ("cyrillic", "m"): "рин", ("cyrillic", "f"): "лия", ("cyrillic", "s"): "вер"}

#: Any entity. What may begin one is tested by its first character or what stands before it, once for several kinds.
_STARTS = {_ALNUM: ("email", "token", "iban"), r"(?=[\d+(])": ("ssn", "ip", "phone", "card"), r"(?=[MDPHFSГДП])": ("name",)}
PATTERN = "|".join(f"{start}(?:{'|'.join(KINDS[k] for k in kinds)})" for start, kinds in _STARTS.items())
DRAW_TASKS = 32      # tasks that draw surrogates: a draw is work, though its rows are small
PLAIN_ROUNDS = 8     # draws in the entity's own length; each later one is a character longer


def _kind(mention: Column) -> Column:
    out = F.lit("name")
    for name in reversed([k for k in KINDS if k != "name"]):
        out = F.when(mention.rlike(f"^(?:{KINDS[name]})$"), name).otherwise(out)
    return out


def _bare(mention: Column) -> Column:
    """Only what identifies: letters and digits, lower case; a country code is set apart."""
    return F.lower(F.regexp_replace(mention, r"[^\p{L}\p{N}]", ""))


def _roles(mention: Column) -> Column:
    """(kind, value) of each word of a name: given names, the family name at the end, an initial, or a kept word."""
    words = F.split(mention, " ")
    given = F.when(mention.rlike(FEMALE), "given f").when(mention.rlike(MALE), "given m").otherwise("given n")

    def one(word, i):
        kind = (F.when(word.rlike(rf"^(?:{TITLE}\.?|{PARTICLE})$"), "kept").when(word.rlike(r"^\p{Lu}\.$"), "initial")
                .when(i == F.size(words) - 1, "family").otherwise(given))
        return F.struct(kind.alias("kind"), word.alias("value"))
    return F.transform(words, one)


def _parts(mention: Column) -> Column:
    """The entities of a mention as (kind, value). A name has one for each given and one for the family name."""
    kind = _kind(mention)
    one = lambda k, v: F.struct(k.alias("kind"), v.alias("value"))
    names = F.filter(_roles(mention), lambda r: ~r["kind"].isin("kept", "initial"))
    code = F.regexp_extract(mention, r"^\+(\d{1,3})(?!\d)", 1)
    value = (F.when(kind == "email", F.lower(mention)).when(kind == "ip", mention)
             .when(kind == "phone", F.concat(code, F.lit("|"), F.substring(_bare(mention), F.length(code) + 1, F.lit(64))))
             .otherwise(_bare(mention)))
    return F.when(kind == "name", names).otherwise(F.array(one(kind, value)))


# Drawing --------------------------------------------------------------------------------------
def _draws(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """256 keyed numbers of 0 to 65,535 as hex, the same for the same entity and attempt."""
    seed = F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string"))
    return F.concat(*(F.sha2(F.concat_ws("|", F.lit(str(b)), seed), 512) for b in range(8)))


def _number(draws: Column, i: Column) -> Column:
    return F.conv(F.substring(draws, (i % 256) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _letter(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), n % len(alphabet) + 1, F.lit(1))


def _by_class(value: Column, draws: Column, keep: Column, letters: str | None = None) -> Column:
    """Every character after the first ``keep`` by one of its class and script; signs stay."""
    def one(i):
        c, n = F.substring(value, i + 1, F.lit(1)), _number(draws, i)
        latin = letters or ALPHABETS["latin"]
        return (F.when(i < keep, c).when(c.rlike("[0-9]"), (n % 10).cast("string"))
                .when(c.rlike(r"\p{IsCyrillic}"), _letter(ALPHABETS["cyrillic"], n))
                .when(c.rlike(r"\p{IsGreek}"), _letter(ALPHABETS["greek"], n))
                .when(c.rlike(r"\p{L}"), _letter(latin, n)).when(c.rlike(r"\p{N}"), (n % 10).cast("string")).otherwise(c))

    chars = F.transform(F.sequence(F.lit(0), F.length(value) - 1), one)
    return F.when(F.length(value) > 0, F.array_join(chars, "")).otherwise(value)


def _luhn(digits: Column) -> Column:
    """The weighted sum whose last digit is 0 for valid card numbers."""
    def weight(i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), weight), F.lit(0), lambda a, x: a + x)


def _card(value: Column, form: Column, draws: Column) -> Column:
    """A number as long as ``form``. The issuer's first digit stays; valid numbers stay valid and invalid ones invalid."""
    body = _by_class(F.substring(form, F.lit(1), F.length(form) - 1), draws, F.lit(1))
    check = F.pmod(-_luhn(F.concat(body, F.lit("0"))), F.lit(10))
    off = F.when(_luhn(value) % 10 == 0, 0).otherwise(1 + _number(draws, F.lit(255)) % 9)
    return F.concat(body, ((check + off) % 10).cast("string"))


def _name(kind: Column, value: Column, draws: Column, attempt: Column) -> Column:
    """A capitalised word of syllables whose ending tells gender; later attempts are longer."""
    def made(script):
        parts = F.array(*(F.lit(s) for s in SYLLABLES[script]))
        stem = F.array_join(F.transform(F.sequence(F.lit(0), 1 + attempt), lambda i: F.element_at(parts, _number(draws, i) % len(SYLLABLES[script]) + 1)), "")
        end = F.when(kind == "given f", ENDINGS[script, "f"]).when(kind == "given m", ENDINGS[script, "m"]).when(kind == "given n", ENDINGS[script, "n"]).otherwise(ENDINGS[script, "s"])
        return F.initcap(F.concat(stem, end))
    return F.when(value.rlike(r"\p{IsCyrillic}"), made("cyrillic")).otherwise(made("latin"))


def _surrogate(kind: Column, value: Column, attempt: int, draws: Column) -> Column:
    more = max(0, attempt + 1 - PLAIN_ROUNDS)
    attempt = F.lit(attempt)
    octet = [(1 + _number(draws, F.lit(i)) % 254).cast("string") for i in range(4 + more)]
    card = _card(value, F.concat(value, F.lit("0" * more)), draws)
    value = F.when(kind == "email", F.concat(F.lit("x" * more), value)).when(
        kind.isin("given m", "given f", "given n", "family"), value).otherwise(F.concat(value, F.lit("0" * more)))
    last = F.length(F.substring_index(value, ".", -1))
    mail = F.concat(_by_class(F.substring(value, F.lit(1), F.length(value) - last), draws, F.lit(0)), F.substring_index(value, ".", -1))
    hexes = value.rlike("^[0-9a-f]{32,}$")
    return (F.when(kind == "email", mail).when(kind == "ip", F.concat_ws(".", *octet)).when(kind == "card", card)
            .when((kind == "token") & hexes, _by_class(value, draws, F.lit(0), "abcdef"))
            .when(kind == "phone", _by_class(value, draws, F.instr(value, "|")))
            .when(kind == "iban", _by_class(value, draws, F.lit(2)))
            .when(kind.isin("given m", "given f", "given n", "family"), _name(kind, value, draws, attempt))
            .otherwise(_by_class(value, draws, F.lit(0))))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate): one surrogate per entity, never two entities with one, never a real entity.

    Entities draw in rounds. A draw counts if no entity that is first by value drew the same, no
    earlier round gave it away, and it is no entity of the data itself. Draws that fail draw anew,
    after some rounds with more and more added characters, so that forms never run out.
    """
    entities = stored(entities.select("kind", "value").distinct())
    pending, given = entities, None
    for attempt in count():
        drawn = pending.repartition(DRAW_TASKS, "kind", "value").select(
            "kind", "value", _draws(key, F.col("kind"), F.col("value"), F.lit(attempt)).alias("draws")).select(
            "kind", "value", _surrogate(F.col("kind"), F.col("value"), attempt, F.col("draws")).alias("surrogate"))
        first = F.row_number().over(W.partitionBy("kind", "surrogate").orderBy("value"))
        real = entities.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("real"))
        tried = drawn.select("*", first.alias("turn")).join(real, ["kind", "surrogate"], "left")
        if given is not None:
            tried = tried.join(given.select("kind", "surrogate", F.lit(True).alias("used")), ["kind", "surrogate"], "left")
        else:
            tried = tried.withColumn("used", F.lit(None).cast("boolean"))
        tried = stored(tried.select("kind", "value", "surrogate", (
            (F.col("turn") == 1) & F.col("real").isNull() & F.col("used").isNull()).alias("good")))
        got = tried.where("good").select("kind", "value", "surrogate")
        given = got if given is None else given.unionByName(got)
        pending = tried.where(~F.col("good")).select("kind", "value")
        if pending.isEmpty():
            return given


def _known_name(known: Column, word: Column, kinds: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.element_at(known, F.concat(F.lit(f"{k}|"), word)) for k in kinds))


def _name_written(mention: Column, known: Column, key: str) -> Column:
    """Titles and particles stay. A given name that a gender is known of elsewhere in the text takes that one's surrogate."""
    def one(r):
        initial = F.concat(F.upper(_letter(ALPHABETS["latin"], _number(F.sha2(F.concat(F.lit(f"{key}|initial|"), r["value"]), 512), F.lit(0)))), F.lit("."))
        given = F.when(r["kind"] == "given n", _known_name(known, r["value"], ("given f", "given m", "given n"))).otherwise(
            F.element_at(known, F.concat_ws("|", r["kind"], r["value"])))
        return F.when(r["kind"] == "kept", r["value"]).when(r["kind"] == "initial", initial).otherwise(given)
    return F.array_join(F.transform(_roles(mention), one), " ")


def _bare_name(word: Column, known: Column) -> Column:
    """The surrogate of an untitled word that is a name in this text, else null."""
    return F.when(word.rlike(r"^\p{Lu}"), _known_name(known, word, ("family", "given f", "given m", "given n")))


def _written(mention: Column, known: Column, key: str) -> Column:
    """The mention with its entities' surrogates, in the mention's own format."""
    kind, parts = _kind(mention), _parts(mention)
    found = lambda i: F.element_at(known, F.concat_ws("|", parts[i]["kind"], parts[i]["value"]))
    bare = F.when(kind == "phone", F.regexp_replace(found(0), r"\|", "")).otherwise(found(0))

    # added characters stand before an address and after anything else
    lead = F.when(kind == "email", F.length(bare) - F.length(mention)).otherwise(0)
    marks = F.length(F.regexp_replace(mention, r"[^\p{L}\p{N}]", ""))
    tail = F.when(kind == "email", "").otherwise(F.substring(bare, marks + 1, F.length(bare)))

    def one(i):
        c = F.substring(mention, i + 1, F.lit(1))
        at = F.when(kind == "email", i + 1 + lead).otherwise(F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), r"[^\p{L}\p{N}]", "")))
        s = F.substring(bare, at, F.lit(1))
        return F.when((kind != "email") & ~c.rlike(r"[\p{L}\p{N}]"), c).when(c.rlike(r"\p{Lu}"), F.upper(s)).otherwise(s)

    spread = F.concat(F.substring(bare, F.lit(1), lead), F.array_join(F.transform(F.sequence(F.lit(0), F.length(mention) - 1), one), ""), tail)
    return F.when(kind == "name", _name_written(mention, known, key)).when(kind == "ip", found(0)).otherwise(spread)


def replace_entities(docs: DataFrame, text_col: str = "text", key: str = "surrogates") -> DataFrame:
    """Every row of ``docs`` with its personal data replaced; adds _n_entities (mentions replaced).

    Found are e-mail addresses, keys and tokens, IBANs, social security numbers, IPv4 addresses,
    phone and card numbers, and names after one or more titles, with particles, initials and hyphens;
    in a text with such a name its given and family names are also found where they stand alone. An entity has one surrogate everywhere,
    whatever its spacing, punctuation or case (coreference), and two entities never share one. Case,
    punctuation, lengths (unless their forms run short), country codes, top-level domains, the validity of card numbers, gender and
    script stay.

    Every text is searched once; the mentions and what stands between them are stored with the rows.
    Texts without entities, empty and null ones are returned as they are and take no part in any
    shuffle. Copies of a text share its entities. Other columns stay, but for those named _n_entities,
    _h, _m, _b and _known.
    """
    docs = docs.drop("_n_entities", "_h", "_m", "_b", "_known")
    text = F.col(text_col)
    names = docs.columns
    searched = stored(docs.withColumn("_m", F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
                      .withColumn("_b", F.when(F.size("_m") > 0, F.split(text, PATTERN, -1))))
    has = F.coalesce(F.size("_m") > 0, F.lit(False))
    hit = searched.where(has)
    listed = (hit.select(text_key(text).alias("_h"), F.explode(F.array_distinct("_m")).alias("m"))
              .select("_h", F.explode(_parts(F.col("m"))).alias("part")).select("_h", "part.kind", "part.value").distinct())
    listed = stored(listed)
    given = assign(listed, key)
    known = listed.join(given, ["kind", "value"]).groupBy("_h").agg(
        F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "value"), "surrogate"))).alias("_known"))
    full = hit.select("*", text_key(text).alias("_h")).join(stored(known), "_h").select(*names, "_m", "_b", "_known")
    new = F.transform("_m", lambda m: _written(m, F.col("_known"), key))
    # between the mentions, names that the text gives with a title stand without one as well
    named = F.exists(F.map_keys("_known"), lambda k: k.startswith("family|"))
    between = F.col("_b")
    pieces = lambda p: F.regexp_extract_all(p, F.lit(PIECE), F.lit(0))
    bare = F.transform(between, lambda p: F.array_join(F.transform(pieces(p), lambda w: F.coalesce(_bare_name(w, F.col("_known")), w)), ""))
    n_bare = F.aggregate(between, F.lit(0), lambda n, p: n + F.size(F.filter(pieces(p), lambda w: _bare_name(w, F.col("_known")).isNotNull())))
    rebuilt = F.array_join(F.zip_with(F.when(named, bare).otherwise(between), F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    done = full.select(*(rebuilt.alias(c) if c == text_col else F.col(c) for c in names),
                       (F.size("_m") + F.when(named, n_bare).otherwise(0)).alias("_n_entities"))
    return searched.where(~has).select(*names, F.lit(0).alias("_n_entities")).unionByName(done)
