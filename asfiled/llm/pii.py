"""Personal data replaced by keyed surrogates of the same kind, script and format.

An entity is told by its payload: the digits of a phone number, an address in lower case, one
word of a name. A keyed hash of kind and payload makes the surrogate's payload, character class
by character class; the surrogate is then laid into the format and case of each occurrence. So
one entity looks alike everywhere, however it is written, and another key gives other surrogates.

Surrogates are worked out where the text lies. All distinct entities are gathered once to check
them: two entities with one surrogate, or a surrogate that is itself an entity of the corpus, move
on to the next attempt of the hash. Only documents that hold such an entity look anything up.
Everything is SQL; no text leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import materialise
from .rows import fresh, text_key

# Titles that announce a name, by gender.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Signora",
          "Госпожа", "Κυρία")
EITHER = ("Dr", "Prof")
#: Titles that also announce a name when title and name are in capitals; short ones may be anything.
CAPITALS = ("MR", "MRS", "MISS", "HERR", "FRAU", "DR", "PROF", "MONSIEUR", "MADAME", "SEÑOR", "SEÑORA")
TITLES = "|".join(MALE + FEMALE + EITHER)


def _chain(titles: str) -> str:
    """One title after another, the last one before a capital letter."""
    return rf"(?:(?:{titles})\.? (?=\p{{Lu}}))+"



_FREE = r"(?<![\p{L}\p{N}])"
_EMAIL = r"[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+"
#: Words that announce a secret, in any case, and a value without blanks up to the marks after it.
_KEYS = r"(?i:token|secret|password|passwd|api[_-]?key)"
_VALUE = r"(?=\S*?[\p{{L}}\p{{N}}])[^\s\x22']\S{{{},}}(?<![\x22'.,;:!?)\]}}>])"
#: Keys that tell themselves by their first four characters.
_ISSUED = "(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,})"
#: One alternative per kind of entity; an occurrence starts at the start of a token.
PATTERN = "|".join((
    r"(?<=[=:\x22'\s])(?<=[=:]\s{0,3}[\x22']?)(?:"
    + "|".join(rf"(?<={_KEYS}[\x22']?\s{{0,3}}[=:]\s{{0,3}}{q})(?=[^{q}\r\n]*?[\p{{L}}\p{{N}}])[^{q}\r\n]++(?={q})"
               for q in (r"\x22", "'"))
    + r"|(?<=(?i:password|passwd)[\x22']?\s{0,3}[=:]\s{0,3}[\x22']?)" + _VALUE.format(0)
    + rf"|(?<={_KEYS}[\x22']?\s{{0,3}}[=:]\s{{0,3}}[\x22']?)" + _VALUE.format(11) + ")",
    r"(?<![\p{L}\p{N}._%+-])" + _EMAIL,
    _FREE + r"(?=[0-9]*+[a-fA-F])[0-9a-fA-F]{32,}+(?![\p{L}\p{N}])",
    _FREE + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"
    r"(?![\p{L}\p{N}])(?!\.\d)",
    _FREE + r"\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}])",
    r"(?<![\p{L}\p{N}+])(?=\+\d++[ .(-]{1,2}\d{2}|\+\d{8})\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?![\p{L}\p{N}])",
    _FREE + r"(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\p{L}\p{N}])",
    _FREE + r"\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}])",
    _FREE + rf"{_chain(TITLES)}\p{{Lu}}[\p{{L}}'’-]++(?: \p{{Lu}}[\p{{L}}'’-]++){{0,2}}(?![\p{{L}}\p{{N}}])",
    _FREE + rf"{_chain('|'.join(CAPITALS))}[\p{{Lu}}'’-]{{2,}}+(?: [\p{{Lu}}'’-]{{2,}}+){{0,2}}(?![\p{{L}}\p{{N}}])",
    _FREE + rf"{_ISSUED}(?![\p{{L}}\p{{N}}])",
))
#: Without one of these a text holds no entity; cheap looks before the long pattern.
_HINT_WORDS = "(?i)token|secret|passw|api|a[ks]ia|gh[pousr]_"
_HINT_TITLE = (rf"(?=[{''.join(sorted({t[0] for t in MALE + FEMALE + EITHER}))}])"
               rf"(?:{TITLES}|{'|'.join(CAPITALS)})\.? \p{{Lu}}")

_SCRIPTS = {  # letters by script, and syllables for names
    "[а-яё]": ("абвгдежзиклмнопрстуфхцчшэюя", "бо ва ди ка ле ми но ра се ту", "ов", "ова"),
    "[α-ωά-ώ]": ("αβγδεζηθικλμνξοπρστυφχψω", "βα γο δι κα λε μι νο ρα σε τυ", "ος", "α"),
    r"\p{L}": ("abcdefghijklmnopqrstuvwxyz", "ba co di fe ga ho li ma ne ro sa tu ve wi", "n", "a"),
}


def _quoted(text: str) -> str:
    return "r'" + text.replace("'", r"\x27") + "'"


def _any_of(titles) -> str:
    every = [*titles, *(c for c in CAPITALS if c in {t.upper() for t in titles})]
    other = "|".join((*EITHER, *(t.upper() for t in EITHER)))
    return _quoted(rf"^(?:(?:{other})\.? (?=\p{{Lu}}))*{_chain('|'.join(every))}")


def hinted(text: str) -> str:
    return (f"({text} rlike '[@0-9]' or {text} rlike {_quoted(_HINT_WORDS)} "
            f"or {text} rlike {_quoted(_HINT_TITLE)})")


def kind_of(m: str) -> str:
    """SQL for the kind of an occurrence ``m``."""
    return f"""case when {m} rlike {_quoted(f"^{_EMAIL}$")} then 'email'
      when {m} rlike {_any_of(MALE + FEMALE + EITHER)} then 'name'
      when {m} rlike {_quoted(r"^[0-9]{1,3}([.][0-9]{1,3}){3}$")} then 'ip'
      when {m} rlike {_quoted("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")} then 'ssn'
      when {m} rlike {_quoted("^[A-Z]{2}[0-9]{2}[ A-Z0-9]+$")} then 'iban'
      when {m} rlike {_quoted("^[0-9][0-9 -]*$")} and
        length(regexp_replace({m}, '[^0-9]', '')) between 13 and 19 then 'card'
      when {m} rlike {_quoted("^(?=.*[0-9])[0-9 ().+-]+$")} then 'phone' else 'secret' end"""


#: What stands before the ten digits of a number of country code 1.
_ZONE = "^1(?=[0-9]{10}$)"


def _words_of(m: str) -> str:
    """SQL for the words of a name without its titles."""
    return f"split(regexp_replace({m}, {_any_of(MALE + FEMALE + EITHER)}, ''), ' ')"


def parts_of(m: str) -> str:
    """SQL for the entities of an occurrence, an array of (kind, payload).

    A name is its words: the last one a surname, those before it given names of the title's
    gender. So a person keeps the surname with or without the given name. A number in the zone
    of the country code 1 is its ten digits.
    """
    words = _words_of(m)
    gender = (f"case when {m} rlike {_any_of(MALE)} then 'male' "
              f"when {m} rlike {_any_of(FEMALE)} then 'female' else 'given' end")
    plain = f"""case {kind_of(m)} when 'email' then lower({m}) when 'ip' then {m}
      when 'secret' then {m} when 'iban' then replace({m}, ' ', '')
      when 'phone' then regexp_replace(regexp_replace({m}, '[^0-9]', ''), {_quoted(_ZONE)}, '')
      else regexp_replace({m}, '[^0-9]', '') end"""
    return f"""if({kind_of(m)} = 'name', transform({words}, (w, i) -> named_struct(
        'kind', if(i = size({words}) - 1, 'surname', {gender}), 'payload', lower(w))),
      array(named_struct('kind', {kind_of(m)}, 'payload', {plain})))"""


def _digits_sum(s: str) -> str:
    """SQL for the check sum of a card number."""
    digit = f"cast(substring({s}, length({s}) - p + 1, 1) as int)"
    return (f"aggregate(transform(sequence(1, length({s})), p -> if(p % 2 = 1, {digit}, "
            f"{digit} * 2 - if({digit} > 4, 9, 0))), 0, (a, x) -> a + x)")


def _mod_97(s: str) -> str:
    """SQL for an account number's remainder, letters read as 10 to 35."""
    return (f"aggregate(transform(sequence(1, length({s})), p -> conv(substring({s}, p, 1), 36, 10)), 0, "
            "(a, x) -> cast((a * if(length(x) = 1, 10, 100) + x) % 97 as int))")


def surrogate(kind: str, payload: str, attempt: str, key: str) -> str:
    """SQL for the surrogate payload at an attempt of the keyed hash."""
    seed = f"concat({key}, '|', {kind}, '|', {payload}, '|', {attempt})"
    noise = (f"array_join(transform(sequence(0, length({payload}) div 32), "
             f"b -> sha2(concat({seed}, '|', b), 256)), '')")
    v = "cast(conv(substring(h, 2 * i - 1, 2), 16, 10) as int)"
    c = f"substring({payload}, i, 1)"

    def pick(letters: str) -> str:
        return f"substring('{letters}', 1 + {v} % {len(letters)}, 1)"

    hexed = f"{payload} rlike '^[0-9a-fA-F]+$'"
    letters = " ".join(f"when {c} rlike r'^{script}$' then {pick(made[0])}"
                       for script, made in _SCRIPTS.items())
    tail = f"i > length({payload}) - length(substring_index({payload}, '.', -1))"
    spelled = f"""array_join(transform(sequence(1, length({payload})), i -> case
      when {kind} = 'email' and {tail} then {c}
      when {kind} = 'phone' and (i <= length({payload}) - 10
        or length({payload}) < 10 and i = 1) then {c}
      when {kind} = 'phone' and i = length({payload}) - 9 then cast(2 + {v} % 8 as string)
      when {kind} = 'card' and i = 1 then {c}
      when {kind} = 'iban' and i <= 2 then {c}
      when {kind} = 'secret' and i <= 4 and {payload} rlike {_quoted(f'^{_ISSUED}$')} then {c}
      when {kind} = 'ssn' and i = 1 then cast(1 + {v} % 8 as string)
      when {c} rlike '^[0-9]$' then cast({v} % 10 as string)
      when {hexed} and {c} rlike '^[a-f]$' then {pick('abcdef')}
      when {hexed} and {c} rlike '^[A-F]$' then {pick('ABCDEF')}
      when {c} rlike '^[A-Z]$' then upper({pick(_SCRIPTS[r'\p{L}'][0])})
      {letters} else {c} end), '')"""
    octets = f"""array_join(transform(split({payload}, '[.]'), (o, k) -> cast(case
      when {attempt} > 7 then 1 + conv(substring(h, 3 * k + 1, 3), 16, 10) % 254
      when length(o) = 1 then 1 + conv(substring(h, 3 * k + 1, 3), 16, 10) % 9
      when length(o) = 2 then 10 + conv(substring(h, 3 * k + 1, 3), 16, 10) % 90
      else 100 + conv(substring(h, 3 * k + 1, 3), 16, 10) % 155 end as int)), '.')"""
    card = f"""transform(array({spelled}), s -> concat(left(s, length(s) - 1), cast(pmod(
      cast(right(s, 1) as int) + {_digits_sum(payload)} - {_digits_sum('s')}, 10) as string)))[0]"""
    turned = "concat(substring({0}, 5), left({0}, 2), {1})"
    iban = f"""transform(array({spelled}), s -> if(
      {_mod_97(turned.format(payload, f'substring({payload}, 3, 2)'))} = 1,
      concat(left(s, 2), lpad(cast(98 - {_mod_97(turned.format('s', "'00'"))} as string), 2, '0'),
      substring(s, 5)), s))[0]"""

    def name(made) -> str:
        syllables = made[1].split()
        listed = ", ".join(f"'{s}'" for s in syllables)
        some = (f"array_join(transform(sequence(0, 2 + {attempt} div 4 + conv(left(h, 2), 16, 10) % 2), "
                f"k -> element_at(array({listed}), cast(1 + conv(substring(h, 3 + 2 * k, 2), 16, 10) "
                f"% {len(syllables)} as int))), '')")
        return (f"concat({some}, case {kind} when 'male' then '{made[2]}' "
                f"when 'female' then '{made[3]}' else '' end)")

    # Formats that are full grow: from the eighth attempt on by a character every eight attempts.
    drawn = f"left(sha2(concat({seed}, '|more'), 256), least({attempt} div 8, 64))"
    more = (f"if({kind} in ('phone', 'card', 'ssn', 'iban'), translate({drawn}, 'abcdef', '012345'), "
            f"translate({drawn}, '0123456789', 'ghijklmnop'))")
    scripts = list(_SCRIPTS.items())
    names = ("case " + " ".join(f"when {payload} rlike r'{s}' then {name(m)}" for s, m in scripts[:-1])
             + f" else {name(scripts[-1][1])} end")
    return f"""transform(array({noise}), h -> case
      when {kind} = 'ip' then {octets}
      when {kind} = 'card' and {attempt} < 8 then {card}
      when {kind} = 'iban' and {attempt} < 8 then {iban}
      when {kind} in ('male', 'female', 'given', 'surname') then {names}
      when {attempt} < 8 then {spelled} when {kind} = 'email' then concat({more}, {spelled})
      else concat({spelled}, {more}) end)[0]"""


def laid_out(m: str, replaced: str) -> str:
    """SQL that lays surrogate payloads (an array) into the format and case of ``m``."""
    one = (f"if({kind_of(m)} = 'phone' and regexp_replace({m}, '[^0-9]', '') rlike {_quoted(_ZONE)}, "
           f"concat('1', {replaced}[0]), {replaced}[0])")
    c, mark = f"substring({m}, j, 1)", "' ()+.-'"
    skipped = f"length(translate(substring({m}, 1, j), {mark}, ''))"
    # What a surrogate has grown by stands in front of an address, and else at the end.
    grown = (f"length({one}) - length(if({kind_of(m)} in ('phone', 'card', 'ssn', 'iban'), "
             f"translate({m}, {mark}, ''), {m}))")
    q = (f"substring({one}, case when {kind_of(m)} in ('phone', 'card', 'ssn', 'iban') then {skipped} "
         f"when {kind_of(m)} = 'email' then j + {grown} else j end, 1)")
    spelled = f"""array_join(transform(sequence(1, length({m})), j -> case
      when {kind_of(m)} in ('phone', 'card', 'ssn', 'iban') and contains({mark}, {c}) then {c}
      when {c} <> lower({c}) then upper({q}) else {q} end), '')"""
    return f"""case {kind_of(m)} when 'name' then concat(
        regexp_extract({m}, {_any_of(MALE + FEMALE + EITHER)}, 0),
        array_join(zip_with({_words_of(m)}, {replaced}, (w, r) -> if(length(w) > 1 and w = upper(w), upper(r), initcap(r))), ' '))
      when 'ip' then {replaced}[0]
      when 'email' then concat(left({replaced}[0], {grown}), {spelled})
      else concat({spelled}, right({one}, {grown})) end"""


def _settled(entities: DataFrame, key: str) -> DataFrame:
    """(kind, payload, final, attempt) of entities that take another kind or whose first
    surrogates collide.

    A given name has one gender in the whole corpus: that of its titles, if those agree. Names of
    all kinds are compared with each other, so no surrogate is a real word of another name.
    """
    entities = materialise(entities.distinct(), "told")
    given = F.col("kind").isin("male", "female", "given")
    genders = (entities.filter(given).groupBy("payload").agg(
        F.min(F.when(F.col("kind") != "given", F.col("kind"))).alias("_b"),
        F.max(F.when(F.col("kind") != "given", F.col("kind"))).alias("_c"))
        .selectExpr("payload", "if(_b = _c, _b, 'given') as final"))
    finals = entities.join(genders.filter("final is not null"), "payload", "left").withColumn(
        "final", F.when(given, F.coalesce("final", "kind")).otherwise(F.col("kind")))
    finals = materialise(finals.select("kind", "payload", "final"), "finals")
    family = F.expr("if(kind in ('male', 'female', 'given', 'surname'), 'name', kind)")
    state = materialise(finals.select(F.col("final").alias("kind"), "payload").distinct()
                        .withColumn("attempt", F.lit(0)), "entities")
    known = state.select(family.alias("family"), F.col("payload").alias("made"),
                         F.lit(True).alias("real")).distinct()
    while True:  # ends, as surrogates grow with the attempts
        made = state.withColumn("family", family).withColumn(
            "made", F.expr(surrogate("kind", "payload", "attempt", key)))
        # Of several entities with one surrogate the smallest at the earliest attempt keeps it.
        owner = made.groupBy("family", "made").agg(
            F.count(F.lit(1)).alias("claims"),
            F.min(F.struct("attempt", "payload", "kind")).alias("owner"))
        clash = (owner.join(known, ["family", "made"], "left")
                 .filter("real or claims > 1").drop("claims"))
        clash = materialise(clash, "clashes")
        if clash.isEmpty():
            break
        moved = (made.join(clash, ["family", "made"], "left").withColumn(
            "attempt", F.expr("attempt + cast(real is true or (owner is not null and "
                              "owner <> struct(attempt, payload, kind)) as int)")))
        state = materialise(moved.select("kind", "payload", "attempt"), "entities")
    return (finals.join(state.withColumnRenamed("kind", "final"), ["final", "payload"])
            .filter("attempt > 0 or final <> kind"))


def replace_entities(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text",
                     count: str | None = None) -> DataFrame:
    """``docs`` with surrogates in place of entities; ``count`` names a column for their number.

    Kinds: e-mail and IPv4 addresses, phone, card and social security numbers, IBANs, secrets
    after words like "token", long hexadecimal strings, names after titles. A surrogate keeps
    punctuation, grouping, case and script, an address its last label, a card its first digit and
    whether its check sum is right, so do account numbers. A given name has the gender of the titles
    it stands behind anywhere, if they agree, so a person is the same behind any of them; a number
    with and without its country code 1 is one. Where the corpus holds so
    many entities of a format that its surrogates run out, surrogates grow longer.

    Texts without entities, null and empty ones come out as they are. Rows are told by id and
    text; a null id is fine, repeated rows are treated alike. Texts are read whole. Other columns
    stay whatever they are named; one named like ``count`` is replaced.
    """
    hits, own, doc, row, moved = fresh(docs, "_found", "_own", "_doc", "_key", "_later")
    secret = "'" + key.replace("\\", "\\\\").replace("'", "\\'") + "'"
    kept = [c for c in docs.columns if count is None or c.lower() != count.lower()]
    pattern = _quoted(PATTERN)
    found = docs.withColumn(hits, F.expr(
        f"if({hinted(f'`{text}`')}, regexp_extract_all(`{text}`, {pattern}, 0), "
        "cast(array() as array<string>))"))
    occurrences = found.filter(f"size({hits}) > 0").select(
        F.col(doc_id).alias("_doc"), text_key(doc_id, text).alias("_key"),
        F.explode(F.array_distinct(hits)).alias("m")).select(
        "_doc", "_key", F.explode(F.expr(parts_of("m"))).alias("e")).select("_doc", "_key", "e.*")
    later = materialise(_settled(occurrences.select("kind", "payload"), secret), "later")

    kind, attempt = "e.kind", "0"
    if not later.isEmpty():
        looked_up = (occurrences.join(later, ["kind", "payload"])
                     .groupBy("_doc", "_key").agg(F.map_from_entries(F.collect_set(F.struct(
                         F.concat_ws(":", "kind", "payload"),
                         F.struct("final", "attempt")))).alias("_later"))
                     .toDF(doc, row, moved))
        found = found.withColumn(own, text_key(doc_id, text))
        found = found.join(looked_up, found[doc_id].eqNullSafe(looked_up[doc])
                           & (F.col(own) == F.col(row)), "left")
        told = f"element_at({moved}, concat_ws(':', e.kind, e.payload))"
        kind, attempt = f"coalesce({told}.final, e.kind)", f"coalesce({told}.attempt, 0)"
    # The kind and attempt are worked out once, before the long expression that names them often.
    replaced = (f"transform(transform({parts_of('m')}, e -> named_struct('kind', {kind}, 'payload', e.payload, "
                f"'attempt', {attempt})), e -> {surrogate('e.kind', 'e.payload', 'e.attempt', secret)})")
    # What stands between the occurrences, and the occurrences, take turns.
    whole = f"""if(size({hits}) > 0, array_join(flatten(zip_with(
        split(`{text}`, {pattern}, -1),
        transform({hits}, m -> transform(array({replaced}), r -> {laid_out('m', 'r')})[0]),
        (gap, m) -> array(gap, coalesce(m, '')))), ''), `{text}`)"""
    columns = [F.expr(whole).alias(c) if c == text else F.col(c) for c in kept]
    if count is not None:
        columns.append(F.greatest(F.size(hits), F.lit(0)).cast("long").alias(count))
    return found.select(*columns)
