"""Format-preserving pseudonyms for personal data: keyed Feistel permutations, as column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.frames import let, quoted

KEY, ROUNDS = "tablewright", 10
# Days from 1900-01-01 to 2099-12-31 are 17 * 4297.
FIRST_DAY, DAY_PARTS = "1900-01-01", (17, 4297)
LETTERS, MONTHS = "abcdefghijklmnopqrstuvwxyz", "January February March April May June July August September October November December".split()

_MONTH = "(?:" + "|".join(MONTHS) + ")"
# Stands before a credential; no other value is found without a digit or @.
_LABEL = r"(?i:password|passwd|token|secret|api[_-]?key)\s{0,2}[=:]"
# In the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "secret": r"(?<![0-9A-Za-z])(?=[a-f]*+[0-9])[0-9a-f]{32,}+(?![0-9A-Za-z])",
    "credential": rf"(?<={_LABEL}\s{{0,2}}[\"']{{0,1}})[^\s\"']{{8,}}+",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
             r"|(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}(?<dash>[.-])[0-9]{3}\k<dash>[0-9]{4}(?![0-9]|[.-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}(?<first>[/-])[0-9]{2}\k<first>[0-9]{2}|[0-9]{1,2}(?<mark>[/.])[0-9]{1,2}\k<mark>[0-9]{4})(?![0-9]|[/.-][0-9])"
            rf"|(?<![0-9A-Za-z])(?:[0-9]{{1,2}} {_MONTH} [0-9]{{4}}|{_MONTH} [0-9]{{1,2}}, [0-9]{{4}})(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|-[0-9])",
}
# A look at the next characters first, as most places begin none; the order holds among those that begin alike.
_BEGINNINGS = {"email": r"(?=[\p{L}0-9._%+-])", "secret": "(?=[0-9a-f]{8})", "credential": r"(?<=[\"'=:\s])(?=[^\s\"']{8})", "iban": "(?=[A-Z]{2}[0-9])", "date": "(?=[0-9JFMASOND])"}
MAY_HAVE = f"[0-9@]|{_LABEL}"
ANY = "|".join(_BEGINNINGS.get(name, "(?=[0-9+(])") + f"(?:{pattern})" for name, pattern in PATTERNS.items())
# Stands around each value that was found; a text that has it already is searched twice instead.
MARK = "\uE8D4"


def _number(text: Column) -> Column:
    return text.cast("long")


def _hash(key: str, tag: Column, turn: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(key), tag, turn.cast("string"), value.cast("string")), 256)


def _hash_number(key, tag, turn, value) -> Column:
    return F.conv(F.substring(_hash(key, tag, turn, value), 1, 15), 16, 10).cast("long")


def permuted(value: Column, left: Column, right: Column, tag: Column, key: str, back: bool) -> Column:
    """A keyed permutation of 0 .. left * right - 1: a Feistel network that adds a hash of one part to the other."""
    sign = -1 if back else 1
    turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def step(at, turn):
        a = F.pmod(at["a"] + sign * (_hash_number(key, tag, turn, at["b"]) % left), left)
        b = F.pmod(at["b"] + sign * (_hash_number(key, tag, turn, at["a"]) % right), right)
        return F.when(turn % 2 == 0, F.struct(a.alias("a"), at["b"].alias("b"))).otherwise(F.struct(at["a"].alias("a"), b.alias("b")))

    start = F.struct(((value - F.pmod(value, right)) / right).cast("long").alias("a"), F.pmod(value, right).alias("b"))
    return F.aggregate(turns, start, step, lambda at: at["a"] * right + at["b"])


def _power(digits: Column) -> Column:
    return F.pow(F.lit(10.0), digits).cast("long")


def _digits(digits: Column, tag: str, key: str, back: bool) -> Column:
    """A string of up to 18 digits permuted among those of its length; an empty one stays."""
    size = F.length(digits)
    half = (size / 2).cast("int")
    name = F.concat(F.lit(tag), size.cast("string"))

    def parts(d):
        high, low = F.substring(d, F.lit(1), size - half), F.substring(d, size - half + 1, half)
        sign = -1 if back else 1
        turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
        left, right = _power(size - half), _power(half)

        def step(at, turn):
            a = F.pmod(at["a"] + sign * (_hash_number(key, name, turn, at["b"]) % left), left)
            b = F.pmod(at["b"] + sign * (_hash_number(key, name, turn, at["a"]) % right), right)
            return F.when(turn % 2 == 0, F.struct(a.alias("a"), at["b"].alias("b"))).otherwise(F.struct(at["a"].alias("a"), b.alias("b")))

        start = F.struct(_number(high).alias("a"), F.coalesce(_number(F.when(half > 0, low)), F.lit(0).cast("long")).alias("b"))
        return F.aggregate(turns, start, step, lambda at: F.concat(
            F.lpad(at["a"].cast("string"), size - half, F.lit("0")),
            F.when(half > 0, F.lpad(at["b"].cast("string"), half, F.lit("0"))).otherwise(F.lit(""))))

    return F.when(size > 0, parts(digits)).otherwise(digits)


def _refilled(shape: Column, digits: Column) -> Column:
    """The digits put in place of those of a text, one by one."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))
    return F.aggregate(F.split(shape, ""), start, lambda at, c: F.when(
        c.between("0", "9"), F.struct(F.concat(at["out"], F.substring(digits, at["next"], F.lit(1))).alias("out"), (at["next"] + 1).alias("next")))
        .otherwise(F.struct(F.concat(at["out"], c).alias("out"), at["next"].alias("next"))), lambda at: at["out"])


def _only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _shifted(text: Column, mark: Column, letters: str, sign: int) -> Column:
    """Every digit and letter moved within its class by a byte of a hash."""
    def move(c, i):
        byte = sign * F.conv(F.substring(mark, 2 * F.pmod(i, F.lit(32)) + 1, F.lit(2)), 16, 10).cast("int")

        def within(alphabet):
            return F.substring(F.lit(alphabet), F.pmod(F.instr(F.lit(alphabet), c) - 1 + byte, F.lit(len(alphabet))) + 1, F.lit(1))

        return (F.when(c.between("0", "9"), within("0123456789")).when(c.between("a", letters[-1]), within(letters))
                .when(c.between("A", letters[-1].upper()), within(letters.upper())).otherwise(c))

    return F.array_join(F.transform(F.split(text, ""), move), "")


def _string(text: Column, tag: str, letters: str, key: str, back: bool) -> Column:
    """A string permuted among those with digits, small and capital letters at the same places."""
    sign = -1 if back else 1
    turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    half = (F.length(text) / 2).cast("int")

    def step(at, turn):
        a = _shifted(at["a"], _hash(key, F.lit(tag), turn, at["b"]), letters, sign)
        b = _shifted(at["b"], _hash(key, F.lit(tag), turn, at["a"]), letters, sign)
        return F.when(turn % 2 == 0, F.struct(a.alias("a"), at["b"].alias("b"))).otherwise(F.struct(at["a"].alias("a"), b.alias("b")))

    start = F.struct(F.substring(text, F.lit(1), half).alias("a"), F.substring(text, half + 1, F.length(text)).alias("b"))
    return F.aggregate(turns, start, step, lambda at: F.concat(at["a"], at["b"]))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, the last one undoubled."""
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(
        c.cast("int") * (1 + i % 2), lambda d: F.when(d > 9, d - 9).otherwise(d))), F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))


def _card(found: Column, key: str, back: bool) -> Column:
    """First digit kept, the check digit follows."""
    def valid(d):
        size = F.length(d)
        body = F.concat(F.substring(d, 1, 1), _digits(F.substring(d, F.lit(2), size - 2), "card", key, back))
        fresh = let(body, lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
        return F.when((luhn_sum(d) % 10 == 0) & ~d.rlike("^(.)\\1*$"), _refilled(found, fresh)).otherwise(found)
    return let(_only_digits(found), valid)


def _phone(found: Column, key: str, back: bool) -> Column:
    """The country's code stays, if it is set apart; else the last ten digits are permuted."""
    code = F.regexp_extract(found, "^\\+([0-9]{1,3})[ (.-]", 1)

    def change(d):
        kept = F.when(code != "", F.length(code)).otherwise(F.greatest(F.length(d) - 10, F.lit(0)))
        return _refilled(found, F.concat(F.substring(d, F.lit(1), kept), _digits(F.substring(d, kept + 1, F.lit(18)), "phone", key, back)))
    return let(_only_digits(found), change)


def _ssn(found: Column, key: str, back: bool) -> Column:
    """Area 1 to 899 but 666, group 1 to 99, serial 1 to 9999."""
    area, group, serial = (_number(F.substring(found, a, n)) for a, n in ((1, 3), (5, 2), (8, 4)))
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    value = (place * 99 + group - 1) * 9999 + serial - 1
    right = 9999

    def write(v):
        high = (v - v % right) / right
        high = high.cast("long")
        spot = ((high - high % 99) / 99).cast("long")
        number = F.when(spot >= 665, spot + 2).otherwise(spot + 1)
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in ((number, 3), (high % 99 + 1, 2), (v % right + 1, 4))])

    fits = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    left, other = F.lit(898 * 99).cast("long"), F.lit(right).cast("long")
    return F.when(fits, let(permuted(value, left, other, F.lit("ssn"), key, back), write)).otherwise(found)


def _ip(found: Column, key: str, back: bool) -> Column:
    part = F.lit(1 << 16).cast("long")

    def change(octets):
        value = F.aggregate(octets, F.lit(0).cast("long"), lambda at, x: at * 256 + _number(x))
        fits = F.forall(octets, lambda x: (_number(x) < 256) & (_number(x).cast("string") == x))
        return F.when(fits, let(permuted(value, part, part, F.lit("ip"), key, back), lambda v: F.concat_ws(
            ".", *[F.shiftright(v, s).bitwiseAND(F.lit(255).cast("long")).cast("string") for s in (24, 16, 8, 0)]))).otherwise(found)

    return let(F.split(found, "\\."), change)


def _iban(found: Column, key: str, back: bool) -> Column:
    """Country and letters kept, all digits of the account permuted, the check digits follow."""
    def rest(text):  # as a number with letters from 10, modulo 97
        return F.aggregate(F.split(text, ""), F.lit(0), lambda at, c: F.when(c == "", at).when(
            c.between("0", "9"), (at * 10 + c.cast("int")) % 97).otherwise((at * 100 + F.ascii(c) - 55) % 97))

    def change(plain):
        account, country = F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 2)
        digits = _only_digits(account)
        # more than 18 do not fit a number
        fresh = F.when(F.length(digits) <= 18, _digits(F.substring(digits, 1, 18), "iban", key, back)).otherwise(_string(digits, "iban", LETTERS, key, back))
        body = _refilled(account, fresh)
        whole = let(body, lambda b: F.concat(F.lpad((98 - rest(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), _only_digits(b)))
        return F.when(rest(F.concat(account, F.substring(plain, 1, 4))) == 1, _refilled(found, whole)).otherwise(found)

    return let(F.regexp_replace(found, " ", ""), change)


def _date(found: Column, key: str, back: bool) -> Column:
    """Days between 1900 and 2099 permuted, the same for all ways to write them; a/b/year is month first if it can be."""
    parts = F.split(found, "[/., -]+")
    a, b, c = (F.get(parts, F.lit(i)) for i in range(3))
    months = F.array(*map(F.lit, MONTHS))

    def change(x):
        year, month, day = x["year"], x["month"], x["day"]
        parsed = F.when(month.between(1, 12) & day.between(1, 31) & year.between(1900, 2099), F.try_to_date(
            F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd"))
        index = F.datediff(parsed, F.lit(FIRST_DAY).cast("date")).cast("long")
        moved = permuted(index, *[F.lit(n).cast("long") for n in DAY_PARTS], F.lit("date"), key, back)

        def write(d):
            y, m, n = F.date_format(d, "yyyy"), F.date_format(d, "MM"), F.date_format(d, "dd")
            short = {True: (m, n), False: (F.month(d).cast("string"), F.dayofmonth(d).cast("string"))}
            mm = F.when(x["wide"], m).otherwise(short[False][0])
            dd = F.when(x["wide"], n).otherwise(short[False][1])
            name = F.get(months, F.month(d) - 1)
            return (F.when(x["form"] == "ymd", F.concat(y, x["sign"], m, x["sign"], n))
                    .when(x["form"] == "dmy", F.concat(dd, x["sign"], mm, x["sign"], y))
                    .when(x["form"] == "mdy", F.concat(mm, x["sign"], dd, x["sign"], y))
                    .when(x["form"] == "dMy", F.concat(dd, F.lit(" "), name, F.lit(" "), y))
                    .otherwise(F.concat(name, F.lit(" "), dd, F.lit(", "), y)))

        return F.when(parsed.isNotNull(), let(F.date_add(F.lit(FIRST_DAY).cast("date"), moved.cast("int")), write)).otherwise(found)

    form = (F.when(found.rlike("^[0-9]{4}"), F.lit("ymd")).when(found.rlike("^[A-Z]"), F.lit("Mdy")).when(found.rlike("[A-Z]"), F.lit("dMy"))
            .when(F.instr(found, ".") > 0, F.lit("dmy")).when((a.try_cast("int") > 12) | (b.try_cast("int") > 31), F.lit("dmy")).otherwise(F.lit("mdy")))

    def read(f):
        number = lambda t: t.try_cast("int")
        year = F.when(f == "ymd", number(a)).otherwise(number(c))
        month = (F.when(f.isin("ymd", "dmy"), number(b)).when(f == "mdy", number(a))
                 .when(f == "dMy", F.array_position(months, b).cast("int")).otherwise(F.array_position(months, a).cast("int")))
        day = F.when(f == "ymd", number(c)).when(f.isin("dmy", "dMy"), number(a)).otherwise(number(b))
        numeric = F.regexp_replace(found, "[^0-9]", "")
        wide = F.when(f.isin("dmy", "mdy"), F.length(numeric) == 8).otherwise(~found.rlike("(^|[^0-9])[0-9]([^0-9]|$)"))
        sign = F.substring(F.regexp_replace(found, "[^/.-]", ""), 1, 1)
        return let(F.struct(f.alias("form"), year.alias("year"), month.alias("month"), day.alias("day"), wide.alias("wide"), sign.alias("sign")), change)

    return let(form, read)


def _email(found: Column, key: str, back: bool) -> Column:
    at = F.instr(found, "@")
    return F.concat(_string(F.substring(found, F.lit(1), at - 1), "email", LETTERS, key, back), F.substring(found, at, F.length(found)))


def _credential(found: Column, key: str, back: bool) -> Column:
    return F.when(found.rlike("^[0-9a-f]+$"), _string(found, "secret", "abcdef", key, back)).otherwise(_string(found, "secret", LETTERS, key, back))


def _kind(found: Column) -> Column:
    kind = F.lit("credential")  # the word before it is not part of it, so it is what matches nothing else
    for name, pattern in reversed(PATTERNS.items()):
        kind = F.when(found.rlike("^(?:" + pattern + ")$"), F.lit(name)).otherwise(kind)
    return kind


def pseudonym(found: Column, key: str = KEY, back: bool = False) -> Column:
    """What stands for a value that one of PATTERNS found; the value itself if it isn't valid."""
    makers = {"email": _email, "iban": _iban, "phone": _phone, "ssn": _ssn, "ip": _ip, "date": _date, "card": _card,
              "secret": lambda x, k, b: _string(x, "secret", "abcdef", k, b), "credential": _credential}

    def make(kind):
        out = found
        for name, maker in makers.items():
            out = F.when(kind == name, maker(found, key, back)).otherwise(out)
        return out

    return let(_kind(found), make)


def pseudonymised(df: DataFrame, text: str = "text", key: str = KEY, back: bool = False, count: str | None = None) -> DataFrame:
    """The rows with emails, secrets, valid IBANs, phone, social security and card numbers, addresses and dates in
    `text` replaced by values of the same format; `count` names a column for the number of replaced values.

    Each kind is a keyed permutation of its format (check digits follow), so equal values get equal pseudonyms in
    all documents, different ones different ones, and `back` with the same key restores the text (dates like
    1/2/2000 may gain zeros). Numbers that
    fail their check stay, as does text outside the matches. Null stays null, an empty text empty; other columns are
    untouched.
    """
    source = quoted(text)
    marked = F.split(F.regexp_replace(source, ANY, f"{MARK}$0{MARK}"), MARK, -1)
    gaps = F.split(source, ANY, -1)
    pieces = F.when(~source.rlike(MAY_HAVE), F.array(source)).when(F.instr(source, MARK) == 0, marked).otherwise(
        F.flatten(F.zip_with(gaps, F.regexp_extract_all(source, F.lit(ANY), F.lit(0)), lambda gap, found: F.array(gap, found))))
    spare = max(map(len, df.columns), default=0)
    old, new = "o" * (spare + 1), "n" * (spare + 1)  # longer than any name in use
    changed = df.withColumn(old, pieces).withColumn(new, F.transform(
        old, lambda x, i: F.when(i % 2 == 1, pseudonym(x, key, back)).otherwise(x)))
    changed = changed.withColumn(text, F.when(F.size(old) > 1, F.array_join(new, "")).otherwise(source))
    if count:
        differ = F.filter(F.zip_with(old, new, lambda a, b: a != b), lambda x: x)
        changed = changed.withColumn(count, F.coalesce(F.size(differ), F.lit(0)).cast("long"))
    return changed.drop(old, new)
