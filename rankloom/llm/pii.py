"""PII: format-preserving Feistel pseudonyms, in SQL functions only.

Candidates are found by one pattern.  Numbers and dates are validated (Luhn for cards, mod 97 for
IBANs, ranges for addresses, the calendar for dates) and permuted within their format by a keyed
Feistel network of eight rounds over sha-256: digits keep their places and separators, a card keeps a
valid check digit, an address stays one, letters and digits of an IBAN's account keep their places.  A
date of any four-digit year stays a date of the same spelling: its separator, the widths of day and
month, and their order where it shows (a part over 12).  It stays within its 400 years (1800 to 2199
and so on), of which all days are permuted where the year comes first; otherwise days from the 13th to
the 28th, later days and 29 February are permuted among themselves, as are dates whose order is open.
The permutation is one to one for each format and depends on the value and the key alone, so equal
values stay linked across documents and different ones stay apart.  Mail addresses and secrets (cloud keys, passwords,
tokens) have no format to permute in; their characters are replaced by a keyed hash in the same alphabet.

Defined results: null text stays null; text without candidates is returned as it is; numbers that do
not validate (an IBAN's account has at least four digits) are left, but valid ones at borders of groups within them are replaced; repeated rows are treated alike.  Empty tables give empty results.  All
columns are kept; a column ``pii_found`` of the input is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import protected, table

#: For tests and comparisons only; give your own.
KEY = "not a secret"
ROUNDS = 8
#: 400 years have 189 * 773 days; those of the years from 200 on (modulo 400) are numbered from this day on.
FIRST_DAY, DAYS_LEFT, DAYS_RIGHT = "2200-01-01", 189, 773
CYCLE, CYCLE_FROM = 400, 200

EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
CLOUD_KEY = r"\bAKIA[0-9A-Z]{16}\b"
SECRET = r"""\b(?i:password|passwd|pwd|token|secret|api[_\-]?key)\s{0,3}[=:]\s{0,3}["']?[A-Za-z0-9_\-+/.]{6,}"""
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
ADDRESS = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
ISO_DATE = r"(?<![0-9\-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9\-])"
DATE = r"(?<![0-9/.])[0-9]{1,2}([/.])[0-9]{1,2}\1[0-9]{4}(?![0-9])"
SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
CARD = r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])"
PHONE = r"(?<![0-9+])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\)[ .\-]?|[0-9]{2,4}[ .\-])[0-9]{3,4}[ .\-][0-9]{3,4}(?![0-9])"
PLUS_PHONE = r"(?<![0-9+])\+[0-9]{8,15}(?![0-9])"
#: In the order in which they are tried.
KINDS = {"email": EMAIL, "cloud_key": CLOUD_KEY, "secret": SECRET, "iban": IBAN, "address": ADDRESS, "iso_date": ISO_DATE, "date": DATE, "ssn": SSN, "card": CARD, "phone": PHONE, "plus_phone": PLUS_PHONE}
#: Runs of groups in which a number may stand beside others; they are cut into pieces.
CARD_RUN = r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,}+(?![0-9]|[./][0-9])|(?<![0-9])[0-9](?:[ \-]?[0-9]){12,}(?![0-9]|[./][0-9])|(?<![0-9])[0-9](?:[ \-]?[0-9]){12,}(?![0-9])"
RUNS = {"iban": IBAN + r"(?:[ \-]?[0-9]+)*", "card": CARD_RUN}
PATTERN = "|".join(f"(?:{RUNS.get(k, p)})" for k, p in KINDS.items())
#: What may stand in a run beside an IBAN or a card.
#: A phone there has one separator, which does not go on to further digits.
INNER_PHONES = [rf"(?<![0-9+])(?<![0-9]{x})[0-9]{{2,4}}{x}[0-9]{{3,4}}{x}[0-9]{{3,4}}(?!{x}?[0-9])" for x in (" ", "-")]
INNER = "|".join(f"(?:{p})" for p in (ADDRESS, ISO_DATE, DATE, SSN, *INNER_PHONES))
#: Prefixes and lengths of the card schemes, asked of a part of a run.
SCHEMES = "^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|5[06-9][0-9]{11,17}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}|3[47][0-9]{13}|3[0689][0-9]{12,17}|35[0-9]{14,17}|6[0-9]{12,18})$"


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _round(key: str, what: str, i: str, half: str) -> str:
    """Sixty keyed bits as a long."""
    return f"cast(conv(substr(sha2(concat_ws(':', {_text(key)}, {what}, {i}, {half}), 256), 1, 15), 16, 10) as bigint)"


def feistel(left: str, right: str, size_left: str, size_right: str, what: str, key: str, result: str) -> str:
    """A permutation of pairs (left, right) below the two sizes; ``result`` is over ``s.l`` and ``s.r``."""
    step = (
        f"if(i % 2 = 1, named_struct('l', (s.l + {_round(key, what, 'i', 's.r')} % {size_left}) % {size_left}, 'r', s.r),"
        f" named_struct('l', s.l, 'r', (s.r + {_round(key, what, 'i', 's.l')} % {size_right}) % {size_right}))"
    )
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('l', {left}, 'r', {right}), (s, i) -> {step}, s -> {result})"


def permuted_digits(digits: str, what: str, key: str) -> str:
    """A string of 2 to 30 digits, permuted among those of its length; ``what`` keeps kinds apart."""
    a, b = "cast(length(g) div 2 as int)", "cast(length(g) - length(g) div 2 as int)"
    power = lambda n: f"cast(power(10, {n}) as bigint)"
    body = feistel(
        f"cast(substr(g, 1, {a}) as bigint)", f"cast(substr(g, {a} + 1) as bigint)", power(a), power(b), f"concat({_text(what)}, length(g))", key,
        f"concat(lpad(cast(s.l as string), {a}, '0'), lpad(cast(s.r as string), {b}, '0'))",
    )
    return _let(digits, "g", body)


def permuted_letters(letters: str, what: str, key: str) -> str:
    """A string of 1 to 26 letters A-Z, permuted among those of its length."""
    powers = f"array({', '.join(f'{26**n}L' for n in range(14))})"
    a, b = "cast(length(g) div 2 as int)", "cast(length(g) - length(g) div 2 as int)"
    number = lambda x: f"aggregate(filter(split({x}, ''), c -> c <> ''), 0L, (t, c) -> t * 26 + ascii(c) - 65)"
    text = lambda n, size: f"if({size} = 0, '', array_join(transform(sequence({size}, 1, -1), j -> char(65 + {n} div element_at({powers}, j) % 26)), ''))"
    body = feistel(
        number(f"substr(g, 1, {a})"), number(f"substr(g, {a} + 1)"), f"element_at({powers}, {a} + 1)", f"element_at({powers}, {b} + 1)", f"concat({_text(what)}, 'letters', length(g))", key,
        f"concat({text('s.l', a)}, {text('s.r', b)})",
    )
    return _let(letters, "g", body)


def _year(years: str) -> str:
    """The four digits of a year, given its place in its cycle; ``g.e`` is the cycle's number."""
    return f"lpad(cast((g.e * {CYCLE} + {years} + {CYCLE_FROM}) % 10000 as string), 4, '0')"


_PLACE = f"(cast({{}} as int) + {10000 - CYCLE_FROM}) % 10000"


def _iso_date(key: str) -> str:
    place = _PLACE.format("substr(m, 1, 4)")
    day = f"datediff(try_to_date(concat({2000 + CYCLE_FROM} + {place} % {CYCLE}, substr(m, 5)), 'yyyy-MM-dd'), date'{FIRST_DAY}')"
    moved = f"date_add(date'{FIRST_DAY}', cast(s.l * {DAYS_RIGHT} + s.r as int))"
    back = _let(moved, "v", f"concat({_year(f'year(v) - {2000 + CYCLE_FROM}')}, date_format(v, '-MM-dd'))")
    body = feistel(f"cast(g.n div {DAYS_RIGHT} as bigint)", f"cast(g.n % {DAYS_RIGHT} as bigint)", str(DAYS_LEFT), str(DAYS_RIGHT), "concat('iso_date', g.e)", key, back)
    return _let(f"named_struct('n', {day}, 'e', {place} div {CYCLE})", "g", f"if(g.n is null, m, {body})")


def _date(key: str) -> str:
    """Of a date with the year last: parts a and b of widths wa and wb, the place y of its year in cycle e."""
    place = _PLACE.format("get(split(m, '[/.]'), 2)")
    parts = ", ".join(f"'{n}', cast(get(split(m, '[/.]'), {i}) as bigint), 'w{n}', length(get(split(m, '[/.]'), {i}))" for i, n in enumerate("ab"))
    parts = f"named_struct({parts}, 'c', if(instr(m, '/') > 0, '/', '.'), 'e', {place} div {CYCLE}, 'y', cast({place} % {CYCLE} as bigint))"
    kept = lambda form: f"concat('date', {_text(form)}, g.wa, g.wb, g.c, g.e)"
    spelled = lambda one, two, year: f"concat(lpad(cast({one} as string), g.wa, '0'), g.c, lpad(cast({two} as string), g.wb, '0'), g.c, {_year(year)})"
    # which of day and month comes first cannot be seen
    size = lambda w: f"if({w} = 1, 9, 12)"
    open_ = feistel("g.y", f"(g.a - 1) * {size('g.wb')} + g.b - 1", str(CYCLE), f"({size('g.wa')} * {size('g.wb')})", kept("open"), key, spelled(f"s.r div {size('g.wb')} + 1", f"s.r % {size('g.wb')} + 1", "s.l"))
    # one part is over 12: the day d, beside the month o of width w
    day_first = lambda day, month, year: f"if(g.a > 12, {spelled(day, month, year)}, {spelled(month, day, year)})"
    first = "if(g.a > 12, 'day', 'month')"
    mid = feistel("g.y", f"(h.d - 13) * {size('h.w')} + h.o - 1", str(CYCLE), f"(16 * {size('h.w')})", f"concat({kept('mid')}, {first})", key, day_first(f"s.r div {size('h.w')} + 13", f"s.r % {size('h.w')} + 1", "s.l"))
    late = [[100 * o + d for o in range(1, last + 1) for d in (29, 30, 31) if not (o == 2 or (d == 31 and o in (4, 6, 9, 11)))] for last in (9, 12)]
    late = "if(h.w = 1, {}, {})".format(*(f"array({', '.join(f'{x}L' for x in xs)})" for xs in late))
    code = _let("get(ds, cast(s.r as int))", "x", day_first("x % 100", "x div 100", "s.l"))
    late = _let(late, "ds", f"if(array_contains(ds, h.o * 100 + h.d), {feistel('g.y', 'array_position(ds, h.o * 100 + h.d) - 1', str(CYCLE), 'size(ds)', f'concat({kept("late")}, {first})', key, code)}, m)")
    years = [y - CYCLE_FROM for y in range(CYCLE_FROM, CYCLE_FROM + CYCLE) if y % 4 == 0 and (y % 100 or y % 400 == 0)]
    leap = f"array({', '.join(f'{y}L' for y in years)})"
    leap = _let(leap, "ys", f"if(array_contains(ys, g.y), {feistel('0L', 'array_position(ys, g.y) - 1', '1', str(len(years)), f'concat({kept("leap")}, {first})', key, day_first('29', '2', 'get(ys, cast(s.r as int))'))}, m)")
    over = f"case when h.o not between 1 and 12 or h.d > 31 then m when h.d <= 28 then {mid} when h.o = 2 and h.d = 29 then {leap} else {late} end"
    over = _let("named_struct('d', greatest(g.a, g.b), 'o', least(g.a, g.b), 'w', if(g.a > 12, g.wb, g.wa))", "h", over)
    return _let(parts, "g", f"if(g.a between 1 and 12 and g.b between 1 and 12, {open_}, {over})")


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_LETTERS = "regexp_replace(m, '[^A-Z]', '')"


def _in_place(digits: str, pattern: str = "[0-9]") -> str:
    """The match with its digits (or what ``pattern`` finds) replaced in order by those of ``digits``."""
    place = f"length(regexp_replace(substr(m, 1, j), '{pattern.replace('[', '[^', 1)}', '')) + 1"
    return _let(digits, "w", f"array_join(transform(split(m, ''), (c, j) -> if(c rlike '{pattern}', substr(w, {place}, 1), c)), '')")


def luhn_sum(digits: str, odd: int) -> str:
    """Luhn's sum; ``odd`` is 1 if the last digit counts once (a whole number), 0 if it counts twice (without its check digit)."""
    digit = "cast(substr(h, p, 1) as int)"
    twice = f"if({digit} > 4, 2 * {digit} - 9, 2 * {digit})"
    return _let(digits, "h", f"aggregate(sequence(1, length(h)), 0, (t, p) -> t + if((length(h) - p) % 2 = {1 - odd}, {digit}, {twice}))")


def _mod97(text: str) -> str:
    """Of an IBAN with its first four characters moved to the end; letters count as 10 to 35."""
    value = "if(c rlike '[0-9]', cast(ascii(c) - 48 as bigint), cast(ascii(c) - 55 as bigint))"
    return _let(text, "q", f"aggregate(filter(split(concat(substr(q, 5), substr(q, 1, 4)), ''), c -> c <> ''), cast(0 as bigint), (t, c) -> if(c rlike '[0-9]', t * 10, t * 100) % 97 + {value}, t -> t % 97)")


def _valid_iban(plain: str) -> str:
    return f"{_mod97(plain)} = 1 and length({plain}) between 15 and 34 and length(regexp_replace(substr({plain}, 5), '[^0-9]', '')) between 4 and 30"


def pieces(run: str) -> str:
    """A run cut into an array of strings: the IBAN it begins with, valid cards between borders of groups, other kinds, and what is between them."""
    iban = (
        "filter(sequence(greatest(15, least(42, length(run))), 15, -1), n -> (n = length(run) or substr(run, n + 1, 1) in (' ', '-'))"
        f" and substr(run, 1, n) rlike {_text('^(?:' + IBAN + ')$')} and {_let("replace(substr(run, 1, n), ' ', '')", 'b', _valid_iban('b'))})"
    )
    head = f"if(run rlike '^[A-Z]', coalesce(get({iban}, 0), 0), 0)"
    digits = "regexp_replace(substr(w, 1, y), '[^0-9]', '')"
    card = (
        f"length(w) >= y and substr(w, 1, y) rlike '^[0-9](?:[ -]?[0-9]){{12,18}}$' and not (substr(w, y + 1, 1) rlike '[0-9]')"
        f" and {digits} rlike {_text(SCHEMES)} and {luhn_sum(digits, 1)} % 10 = 0"
    )
    found = _let("substr(r, x, 38)", "w", f"transform(filter(sequence(13, 37), y -> {card}), y -> named_struct('k', if(length({digits}) = 16, 0, 1), 'z', -y, 'p', x, 'n', y))")
    starts = "filter(sequence(1, length(r)), x -> substr(r, x, 1) rlike '[0-9]' and (x = 1 or substr(r, x - 1, 1) in (' ', '-')))"
    # of cards that overlap those of 16 digits go first, then the longer, then the earlier
    chosen = _let(
        f"array_sort(flatten(transform({starts}, x -> {found})))", "all_",
        "array_sort(transform(aggregate(all_, filter(all_, c -> false), (acc, c) -> if(exists(acc, d -> c.p < d.p + d.n and d.p < c.p + c.n), acc, concat(acc, array(c)))), c -> named_struct('p', c.p, 'n', c.n)))",
    )
    inner = lambda gap: _let(gap, "g", f"flatten(zip_with(split(g, {_text(INNER)}, -1), concat(regexp_extract_all(g, {_text(INNER)}, 0), array('')), (a, b) -> array(a, b)))")
    after = lambda i: f"if({i} < 0, 1, get(cs, {i}).p + get(cs, {i}).n)"
    # a run that only looks like an IBAN and holds no card is left whole
    lone = "hd = 0 and run rlike '^[A-Z]' and size(cs) = 0"
    cut = _let(chosen, "cs", f"if({lone}, array(r), concat(flatten(transform(cs, (c, i) -> concat({inner(f'substr(r, {after('i - 1')}, c.p - {after('i - 1')})')}, array(substr(r, c.p, c.n))))), {inner(f'substr(r, {after('size(cs) - 1')})')}))")
    rest = _let("substr(run, hd + 1)", "r", f"if(r = '', array(''), {cut})")
    whole = f"run rlike {_text('^(?:' + CARD + ')$')} and {luhn_sum(_DIGITS.replace('(m,', '(run,'), 1)} % 10 = 0"
    return _let(run, "run", f"if({whole}, array(run), {_let(head, 'hd', f'concat(array(substr(run, 1, hd)), {rest})')})")


def _hashed(alphabet: str, value: str, size: str, key: str, what: str) -> str:
    """``size`` characters of an alphabet (a power of two of them at most 64, or 16), by a keyed hash."""
    at = f"cast(conv(substr(sha2(concat_ws(':', {_text(key)}, {_text(what)}, {value}, cast(z as string)), 256), 1, 8), 16, 10) as bigint) % {len(alphabet)}"
    return f"array_join(transform(sequence(1, {size}), z -> substr({_text(alphabet)}, cast({at} + 1 as int), 1)), '')"


def replacement(kind: str, key: str) -> str:
    """SQL over a match ``m`` of a kind: its pseudonym, or itself if it does not validate."""
    low, up, hex_ = "abcdefghijklmnopqrstuvwxyz234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdef"
    if kind == "email":
        name, domain = "lower(substring_index(m, '@', 1))", "lower(substring_index(m, '@', -1))"
        return f"concat({_hashed(low, f'concat({name}, {_text('@')}, {domain})', '12', key, 'mail')}, '@', {_hashed(low, domain, '8', key, 'domain')}, '.example')"
    if kind == "cloud_key":
        return f"concat('AKIA', {_hashed(up, 'm', '16', key, 'cloud')})"
    if kind == "secret":
        head = "regexp_extract(m, " + _text(r"""^([A-Za-z_\-]+\s*[=:]\s*["']?)""") + ", 1)"
        tail = "substr(m, length(y) + 1)"
        return _let(head, "y", f"concat(y, {_hashed(hex_, tail, f'length({tail})', key, 'secret')})")
    if kind == "iban":
        plain = "replace(m, ' ', '')"
        # digits and letters of the account permuted in place, then new check digits
        body = _let("substr(b, 5)", "m", _let(_in_place(permuted_digits(_DIGITS, "iban", key)), "m", f"if(m rlike '[A-Z]', {_in_place(permuted_letters(_LETTERS, 'iban', key), '[A-Z]')}, m)"))
        check = f"lpad(cast(98 - {_mod97('concat(substr(b, 1, 2), {}, e)'.format(_text('00')))} as string), 2, '0')"
        whole = _let(body, "e", f"concat(substr(b, 1, 2), {check}, e)")
        valid = _valid_iban("b")
        return _let(plain, "b", f"if({valid}, {_in_place(whole, '[A-Z0-9]')}, m)")
    if kind == "address":
        octet = lambda n: f"cast(split(m, '\\\\.')[{n}] as bigint)"
        valid = " and ".join(f"{octet(n)} < 256" for n in range(4))
        moved = feistel(f"{octet(0)} * 256 + {octet(1)}", f"{octet(2)} * 256 + {octet(3)}", "65536", "65536", "'address'", key, "concat_ws('.', s.l div 256, s.l % 256, s.r div 256, s.r % 256)")
        return f"if({valid}, {moved}, m)"
    if kind == "iso_date":
        return _iso_date(key)
    if kind == "date":
        return _date(key)
    if kind == "card":
        valid = f"{luhn_sum(_DIGITS, 1)} % 10 = 0"
        payload = permuted_digits(f"substr({_DIGITS}, 1, length({_DIGITS}) - 1)", "card", key)
        whole = _let(payload, "u", f"concat(u, cast((10 - {luhn_sum('u', 0)} % 10) % 10 as string))")
        return f"if({valid}, {_in_place(whole)}, m)"
    if kind == "phone":  # a country code stays
        code = f"length(regexp_replace(regexp_extract(m, '^\\\\+[0-9]+', 0), '[^0-9]', ''))"
        whole = f"concat(substr({_DIGITS}, 1, {code}), {permuted_digits(f'substr({_DIGITS}, {code} + 1)', 'phone', key)})"
        return _in_place(whole)
    return _in_place(permuted_digits(_DIGITS, kind, key))


def pseudonymise(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with pseudonyms in place of personal data in ``text``, and pii_found, their number."""
    cases = "m"
    for kind, pattern in reversed(KINDS.items()):
        cases = f"if(m rlike {_text('^(?:' + pattern + ')$')}, {replacement(kind, key)}, {cases})"
    kept = [c for c in docs.columns if c != "pii_found"]
    free = "_" * (1 + max((len(c) for c in kept), default=0))  # longer than any column's name
    names = [free + n for n in ("found", "parts", "new")]
    found = docs.drop("pii_found").withColumn(names[0], F.expr(f"regexp_extract_all(`{text}`, {_text(PATTERN)}, 0)"))
    runs = _text("^(?:" + "|".join(RUNS.values()) + ")$")
    found = found.withColumn(names[1], F.when(F.size(names[0]) > 0, F.expr(f"transform({names[0]}, m -> if(m rlike {runs}, {pieces('m')}, array(m)))")))
    found = found.withColumn(names[2], F.expr(f"transform({names[1]}, u -> transform(u, m -> {cases}))"))
    whole = F.expr(f"array_join(zip_with(split(`{text}`, {_text(PATTERN)}, -1), concat(transform({names[2]}, u -> array_join(u, '')), array('')), (a, b) -> concat(a, b)), '')")
    count = F.expr(f"size(filter(zip_with(flatten({names[1]}), flatten({names[2]}), (a, b) -> a <> b), x -> x))")
    changed = F.size(names[0]) > 0
    return found.withColumns({text: F.when(changed, whole).otherwise(F.col(text)), "pii_found": F.when(changed, count).otherwise(0)}).drop(*names)


def without_pii(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with the same columns, pseudonyms in place of personal data."""
    return protected(docs, (text,), lambda d: pseudonymise(d, text, key))


def op9_pii_pseudonyms(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
