"""Text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import FUNCTIONS, Cell, as_text, bad, function, guarded, let, text
from .math import scaled

MOST = 32767


def whole(n: Column) -> Column:
    return F.floor(n).cast("int")


def same(name: str, *aliases: str) -> None:
    function(name, "t", *aliases)(lambda s: s)


same("ASC", "DBCS", "JIS")
function("LOWER", "t")(F.lower)
function("UPPER", "t")(F.upper)
function("LEN", "t")(lambda s: F.char_length(s).cast("double"))
function("LENB", "t")(lambda s: (2 * F.char_length(s) - F.length(F.regexp_replace(s, r"[^\x00-\x7F]", ""))).cast("double"))
function("TRIM", "t")(lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
function("CLEAN", "t")(lambda s: F.regexp_replace(s, r"[\x00-\x1F]", ""))
function("EXACT", "t t")(lambda a, b: a == b)
function("T", "v")(lambda x: F.when(F.typeof(x) == "string", F.coalesce(x.cast("string"), F.lit(""))).otherwise(""))
function("N", "v")(lambda x: F.when(F.typeof(x) == "string", 0.0).otherwise(F.coalesce(x.try_cast("double"), F.lit(0.0))))


@function("PROPER", "t")
def proper(s):
    """A letter is upper case after anything that isn't a letter."""
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("letter"))
    step = lambda a, c: F.struct(F.concat(a["out"], F.when(a["letter"], F.lower(c)).otherwise(F.upper(c))).alias("out"), c.rlike(r"\p{L}").alias("letter"))
    return F.aggregate(F.split(s, ""), start, step, lambda a: a["out"])


@function("CONCAT", "*t", "CONCATENATE")
def concat(parts):
    s = F.concat(*parts)
    return guarded(s, bad((F.length(s) > MOST, "#VALUE!")))


@function("TEXTJOIN", "t l *t")
def textjoin(delimiter, skip, parts):
    kept = F.array(*parts)
    s = array_join(F.filter(kept, lambda p: ~skip | (p != "")), delimiter)
    return guarded(s, bad((F.length(s) > MOST, "#VALUE!")))


@function("LEFT", "t n=1")
def left(s, n):
    return guarded(F.left(s, whole(n)), bad((n < 0, "#VALUE!")))


@function("RIGHT", "t n=1")
def right(s, n):
    return guarded(F.when(whole(n) > 0, F.right(s, whole(n))).otherwise(""), bad((n < 0, "#VALUE!")))


@function("MID", "t n n")
def mid(s, start, n):
    return guarded(F.substr(s, F.greatest(whole(start), F.lit(1)), F.greatest(whole(n), F.lit(0))), bad(((start < 1) | (n < 0), "#VALUE!")))


def widths(s: Column) -> Column:
    """(character, byte place before it, byte place after it): ASCII is one byte, others two."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    start = F.array().cast("array<struct<c:string,a:int,b:int>>")

    def step(acc, c):
        at = F.coalesce(F.try_element_at(acc, F.lit(-1))["b"], F.lit(0))
        return F.concat(acc, F.array(F.struct(c.alias("c"), at.alias("a"), (at + F.when(c.rlike(r"^[\x00-\x7F]$"), 1).otherwise(2)).alias("b"))))

    return F.aggregate(chars, start, step)


def byte_slice(s: Column, a: Column, b: Column) -> Column:
    """The characters that lie wholly between byte places a and b."""
    return let(widths(s), lambda w: F.array_join(F.transform(F.filter(w, lambda x: (x["a"] >= a) & (x["b"] <= b)), lambda x: x["c"]), ""))


def byte_length(s: Column) -> Column:
    return 2 * F.char_length(s) - F.length(F.regexp_replace(s, r"[^\x00-\x7F]", ""))


@function("LEFTB", "t n=1")
def leftb(s, n):
    return guarded(byte_slice(s, F.lit(0), whole(n)), bad((n < 0, "#VALUE!")))


@function("RIGHTB", "t n=1")
def rightb(s, n):
    total = byte_length(s)
    return guarded(byte_slice(s, total - whole(n), total), bad((n < 0, "#VALUE!")))


@function("MIDB", "t n n")
def midb(s, start, n):
    a = whole(start) - 1
    return guarded(byte_slice(s, a, a + whole(n)), bad(((start < 1) | (n < 0), "#VALUE!")))


@function("FIND", "t t n=1")
def find(needle, s, start):
    at = F.call_function("locate", needle, s, F.greatest(whole(start), F.lit(1)))
    return guarded(at.cast("double"), bad(((start < 1) | (at == 0), "#VALUE!")))


@function("FINDB", "t t n=1")
def findb(needle, s, start):
    at = F.call_function("locate", needle, s, F.greatest(whole(start), F.lit(1)))
    return guarded((byte_length(F.substr(s, F.lit(1), at - 1)) + 1).cast("double"), bad(((start < 1) | (at == 0), "#VALUE!")))


def wildcard(pattern: Column) -> Column:
    """Regular expression of a pattern with * and ?, ~ before either taking it literally."""
    quoted = F.regexp_replace(pattern, r"([\\^$.|+()\[\]{}])", r"\\$1")
    out = F.regexp_replace(quoted, r"(?<!~)\*", r"[\\s\\S]*")
    out = F.regexp_replace(out, r"(?<!~)\?", r"[\\s\\S]")
    return F.regexp_replace(out, r"~([*?~])", r"\\$1")


def search_place(pattern: Column, s: Column, start: Column) -> Column:
    from_ = F.greatest(whole(start), F.lit(1))
    rest = F.substr(s, from_)
    lead = F.call_function("regexp_instr", rest, F.concat(F.lit("(?i)"), wildcard(pattern)))
    return F.when(lead > 0, lead + from_ - 1).otherwise(0)


@function("SEARCH", "t t n=1")
def search(pattern, s, start):
    at = search_place(pattern, s, start)
    return guarded(at.cast("double"), bad(((start < 1) | (at == 0), "#VALUE!")))


@function("SEARCHB", "t t n=1")
def searchb(pattern, s, start):
    at = search_place(pattern, s, start)
    return guarded((byte_length(F.substr(s, F.lit(1), at - 1)) + 1).cast("double"), bad(((start < 1) | (at == 0), "#VALUE!")))


@function("REPLACE", "t n n t")
def replace(s, start, n, new):
    a, k = whole(start), whole(n)
    return guarded(F.concat(F.substr(s, F.lit(1), a - 1), new, F.substr(s, F.greatest(a + k, F.lit(1)))), bad(((start < 1) | (n < 0), "#VALUE!")))


@function("REPLACEB", "t n n t")
def replaceb(s, start, n, new):
    a = whole(start) - 1
    total = byte_length(s)
    return guarded(F.concat(byte_slice(s, F.lit(0), a), new, byte_slice(s, a + whole(n), total)), bad(((start < 1) | (n < 0), "#VALUE!")))


def parts(s: Column, delimiter: Column) -> Column:
    """``s`` split at each literal ``delimiter``."""
    return F.call_function("split", s, F.concat(F.lit(r"\Q"), delimiter, F.lit(r"\E")))


@function("SUBSTITUTE", "t t t n=")
def substitute(s, old, new, nth=None):
    if nth is None:
        return guarded(F.replace(s, old, new), bad((old == "", "#VALUE!")))
    k = whole(nth)
    cut = lambda p: F.when(F.size(p) > k, F.concat_ws("", array_join(F.slice(p, F.lit(1), k), old), new, array_join(F.slice(p, k + 1, F.greatest(F.size(p) - k, F.lit(0))), old))).otherwise(s)
    return guarded(F.when((k >= 1) & (old != ""), let(parts(s, old), cut)), bad(((old == "") | (k < 1), "#VALUE!")))


def array_join(a: Column, delimiter: Column) -> Column:
    return F.call_function("array_join", a, delimiter)


def _cut(name: str, before: bool) -> None:
    @function(name, "t t n=1 n=0 n=0 v=")
    def body(s, delimiter, n, mode, match_end, missing=None):
        k = whole(n)
        fold = lambda x: F.when(mode == 1, F.lower(x)).otherwise(x)

        def pick(p):
            count = F.size(p) - 1
            i = F.when(k > 0, k).otherwise(count + 1 + k)
            inside = (i >= 1) & (i <= count)
            at = F.char_length(array_join(F.slice(p, F.lit(1), F.greatest(i, F.lit(1))), delimiter))
            found = F.left(s, at) if before else F.substr(s, at + F.char_length(delimiter) + 1)
            end = (match_end == 1) & (F.abs(k) == count + 1)
            edge = F.when(k > 0, s if before else F.lit("")).otherwise(F.lit("") if before else s)
            return F.when(inside, found).when(end, edge)

        got = F.when(delimiter == "", F.when(k > 0, F.lit("") if before else s).otherwise(s if before else F.lit(""))).otherwise(let(parts(fold(s), fold(delimiter)), pick))
        if missing is not None:
            return guarded(F.coalesce(got, missing.cast("string")), bad((k == 0, "#VALUE!")))
        return guarded(got, bad((k == 0, "#VALUE!"), (got.isNull(), "#N/A")))


_cut("TEXTBEFORE", True)
_cut("TEXTAFTER", False)


@function("TEXTSPLIT", "t t")
def textsplit(s, delimiter):
    """All tokens, as an array; its first element is the value in one cell."""
    return parts(s, delimiter)


@function("REGEXTEST", "t t n=0")
def regextest(s, pattern, case):
    return F.rlike(s, F.when(case == 1, F.concat(F.lit("(?i)"), pattern)).otherwise(pattern))


@function("REGEXEXTRACT", "t t n=0 n=0")
def regexextract(s, pattern, mode, case):
    """Mode 0: the first match; 1: all matches, joined by commas; 2: the first match's groups, likewise."""
    p = F.when(case == 1, F.concat(F.lit("(?i)"), pattern)).otherwise(pattern)
    found = F.call_function("regexp_extract_all", s, p, F.lit(0))
    first = F.try_element_at(found, F.lit(1))
    return guarded(F.when(mode == 1, F.array_join(found, ",")).otherwise(first), bad((first.isNull(), "#N/A")))


@function("REGEXREPLACE", "t t t n=0 n=0")
def regexreplace(s, pattern, new, occurrence, case):
    """Occurrence 0: all; n: the nth; -n: the nth from the end."""
    p = F.when(case == 1, F.concat(F.lit("(?i)"), pattern)).otherwise(pattern)
    k = whole(occurrence)
    matches = F.call_function("regexp_extract_all", s, p, F.lit(0))

    def nth(m):
        i = F.when(k > 0, k).otherwise(F.size(m) + 1 + k)
        start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("n"), F.lit("").alias("out"))

        def step(a, x):
            where = F.call_function("locate", x, s, a["at"])
            piece = F.substr(s, a["at"], where - a["at"])
            put = F.when(a["n"] + 1 == i, F.regexp_replace(x, p, new)).otherwise(x)
            return F.struct((where + F.char_length(x)).alias("at"), (a["n"] + 1).alias("n"), F.concat(a["out"], piece, put).alias("out"))

        return F.aggregate(m, start, step, lambda a: F.concat(a["out"], F.substr(s, a["at"])))

    return F.when(k == 0, F.regexp_replace(s, p, new)).otherwise(let(matches, nth))


@function("REPT", "t n")
def rept(s, n):
    return guarded(F.when(F.char_length(s) * n <= MOST, F.repeat(s, whole(n))), bad(((n < 0) | (F.char_length(s) * F.floor(n) > MOST), "#VALUE!")))


def from_code(n: Column) -> Column:
    """The character of a code point, through its UTF-8 bytes."""
    c = n.cast("int")
    byte = lambda x: F.unhex(F.lpad(F.hex(x.cast("int")), 2, "0"))
    tail = lambda shift: byte(F.lit(128) + F.shiftright(c, shift).bitwiseAND(F.lit(63)))
    raw = F.when(c < 128, byte(c)).when(c < 2048, F.concat(byte(F.lit(192) + F.shiftright(c, 6)), tail(0))).when(c < 65536, F.concat(byte(F.lit(224) + F.shiftright(c, 12)), tail(6), tail(0))).otherwise(F.concat(byte(F.lit(240) + F.shiftright(c, 18)), tail(12), tail(6), tail(0)))
    return F.decode(raw, "UTF-8")


@function("CHAR", "n")
def char(n):
    k = F.floor(n)
    return guarded(F.when((k >= 1) & (k <= 255), from_code(k)), bad(((k < 1) | (k > 255), "#VALUE!")))


@function("UNICHAR", "n")
def unichar(n):
    k = F.floor(n)
    wrong = (k < 1) | (k > 1114111) | ((k >= 55296) & (k <= 57343))
    return guarded(F.when(~wrong, from_code(k)), bad((wrong, "#VALUE!")))


@function("CODE", "t", "UNICODE")
def code(s):
    return guarded(F.ascii(s).cast("double"), bad((s == "", "#VALUE!")))


@function("VALUE", "v")
def value(x):
    """A number, or the number that a text writes: signs, thousands, currency, percent, brackets for minus."""
    s = F.trim(as_text(x))
    minus = s.rlike(r"^\(.*\)$")
    bare = F.regexp_replace(s, r"[$,()\s]", "")
    percent = F.char_length(F.regexp_replace(bare, "[^%]", ""))
    v = F.regexp_replace(bare, "%", "").try_cast("double") / F.pow(F.lit(100.0), percent)
    clock = F.regexp_extract(s, r"^(\d{1,2}):(\d{2})(?::(\d{2}))?$", 0)
    time = F.when(clock != "", (F.split(clock, ":")[0].try_cast("double") * 3600 + F.get(F.split(clock, ":"), 1).try_cast("double") * 60 + F.coalesce(F.get(F.split(clock, ":"), 2).try_cast("double"), F.lit(0.0))) / 86400)
    date = F.datediff(F.coalesce(F.call_function("try_to_date", s, F.lit("yyyy-M-d")), F.call_function("try_to_date", s, F.lit("M/d/yyyy"))), F.lit("1899-12-30").cast("date")).cast("double")
    out = F.coalesce(F.when(minus, -v).otherwise(v), time, date)
    return guarded(F.when(x.isNull(), 0.0).otherwise(out), bad((x.isNotNull() & out.isNull(), "#VALUE!")))


@function("NUMBERVALUE", "t t=. t=,")
def numbervalue(s, decimal, group):
    bare = F.replace(F.regexp_replace(s, r"\s", ""), group, F.lit(""))
    percent = F.char_length(F.regexp_replace(bare, "[^%]", ""))
    v = F.regexp_replace(F.replace(bare, decimal, F.lit(".")), "%", "").try_cast("double") / F.pow(F.lit(100.0), percent)
    out = F.when(bare == "", 0.0).otherwise(v)
    return guarded(out, bad((out.isNull(), "#VALUE!")))


def fixed_text(x: Column, digits: Column, commas: Column | bool = True) -> Column:
    d = F.greatest(digits.cast("int"), F.lit(0))
    rounded = scaled(x, digits, lambda v: F.floor(v + 0.5))
    shown = F.call_function("format_number", rounded.cast("decimal(38,10)"), d)
    commas = F.lit(commas) if isinstance(commas, bool) else commas
    return F.when(commas, shown).otherwise(F.regexp_replace(shown, ",", ""))


@function("FIXED", "n n=2 l=false")
def fixed(x, digits, plain_):
    return guarded(fixed_text(x, digits, ~plain_), bad(((F.abs(digits) > 127), "#VALUE!")))


@function("DOLLAR", "n n=2")
def dollar(x, digits):
    shown = F.concat(F.lit("$"), fixed_text(F.abs(x), digits))
    return F.when(x < 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)


def text_format(x, pattern: str) -> Cell:
    """TEXT with a literal format: digits (0 # , . %), or date and time letters for dates and timestamps."""
    from .core import cell, number

    letters = set(pattern.lower()) & set("ymdhs")
    if letters:
        java = pattern
        for a, b in (("dddd", "EEEE"), ("ddd", "EEE"), ("mmmm", "MMMM"), ("mmm", "MMM")):
            java = java.replace(a, b)
        time = java.find("h") >= 0 or java.find("s") >= 0
        cut = java.find("h") if time and java.find("h") >= 0 else len(java)
        java = java[:cut].replace("m", "M") + (java[cut:].replace("h", "H") if "am/pm" not in pattern.lower() else java[cut:].replace("AM/PM", "a").replace("am/pm", "a"))
        c = cell(x)
        return Cell(F.date_format(c.value, java), c.error)
    c = number(x)
    body = pattern.rstrip("%")
    percent = len(pattern) - len(body)
    whole_part, _, fraction = body.partition(".")
    least, most = fraction.count("0"), len(fraction)
    v = scaled(c.value * 100.0**percent, F.lit(float(most)), lambda y: F.floor(y + 0.5))
    shown = F.call_function("format_number", F.abs(v).cast("decimal(38,10)"), F.lit(most))
    if "," not in whole_part:
        shown = F.regexp_replace(shown, ",", "")
    if most > least:
        shown = F.regexp_replace(shown, rf"(\.\d{{{least}}}\d*?)0+$", "$1") if least else F.regexp_replace(F.regexp_replace(shown, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    digits = whole_part.replace(",", "").count("0")
    if digits > 1:
        head = F.regexp_extract(shown, r"^[\d,]*", 0)
        shown = F.concat(F.lpad(head, F.greatest(F.lit(digits), F.length(head)), "0"), F.regexp_replace(shown, r"^[\d,]*", ""))
    elif digits == 0:
        shown = F.regexp_replace(shown, r"^0(?=\.|$)", "")
    return guarded(F.concat(F.when(v < 0, "-").otherwise(""), shown, F.lit("%" * percent)), c.error)


FUNCTIONS["TEXT"] = text_format


@function("VALUETOTEXT", "v n=0", "ARRAYTOTEXT")
def valuetotext(x, strict):
    s = F.coalesce(as_text(x), F.lit(""))
    return F.when((strict == 1) & (F.typeof(x) == "string"), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


@function("HYPERLINK", "t t=", "IMAGE")
def hyperlink(link, label=None):
    return link if label is None else label


@function("PHONETIC", "t")
def phonetic(s):
    """Plain text has no phonetic channel of its own."""
    return s


@function("ENCODEURL", "t")
def encodeurl(s):
    return F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


#: Script ranges and the language each stands for.
SCRIPTS = [(r"[가-힯]", "ko"), (r"[぀-ヿ]", "ja"), (r"[一-鿿]", "zh"), (r"[Ѐ-ӿ]", "ru"), (r"[؀-ۿ]", "ar"), (r"[A-Za-z]", "en")]


@function("DETECTLANGUAGE", "t")
def detectlanguage(s):
    """The language of the first of SCRIPTS that has a letter in the text, else ``und``."""
    out = F.lit("und")
    for pattern, lang in reversed(SCRIPTS):
        out = F.when(F.rlike(s, F.lit(pattern)), lang).otherwise(out)
    return guarded(out, None)


@function("TRANSLATE", "t t= t=")
def translate(s, source=None, target=None):
    """There is no translation service: the text itself."""
    return s


def filterxml(x, path: str) -> Cell:
    c = text(x)
    found = F.xpath(c.value, F.lit(f"{path}/text()"))
    return guarded(F.try_element_at(found, F.lit(1)), merged_missing(c, found))


def merged_missing(c: Cell, found: Column) -> Column:
    missing = F.when(F.size(found) < 1, "#VALUE!")
    return missing if c.error is None else F.coalesce(c.error, missing)


FUNCTIONS["FILTERXML"] = filterxml


@function("WEBSERVICE", "t")
def webservice(url):
    """data: URLs only; there is no network."""
    inner = F.regexp_extract(url, r"^data:[^,]*?(;base64)?,([\s\S]*)$", 2)
    packed = url.rlike(r"^data:[^,]*;base64,")
    found = F.when(packed, F.decode(F.unbase64(inner), "UTF-8")).otherwise(F.url_decode(inner))
    ok = F.startswith(url, F.lit("data:"))
    return guarded(F.when(ok, found), bad((~ok, "#VALUE!")))


#: Thai digits and places.
THAI = ["ศูนย์", "หนึ่ง", "สอง", "สาม", "สี่", "ห้า", "หก", "เจ็ด", "แปด", "เก้า"]
PLACES = ["", "สิบ", "ร้อย", "พัน", "หมื่น", "แสน"]


def _thai_group(digits: Column) -> Column:
    """Words of up to six digits, the leading zeros included."""
    names = F.array(*map(F.lit, THAI))
    places = F.array(*map(F.lit, PLACES))
    chars = F.filter(F.split(F.lpad(digits, 6, "0"), ""), lambda c: c != "")

    def word(c: Column, i: Column) -> Column:
        d, p = c.cast("int"), F.lit(5) - i
        earlier = F.substr(F.lpad(digits, 6, "0"), F.lit(1), i).rlike("[1-9]")
        return F.when(d == 0, "").when((p == 1) & (d == 1), "สิบ").when((p == 1) & (d == 2), "ยี่สิบ").when((p == 0) & (d == 1) & earlier, "เอ็ด").otherwise(F.concat(F.get(names, d), F.get(places, p)))

    return F.array_join(F.transform(chars, word), "")


@function("BAHTTEXT", "n")
def bahttext(x):
    satang = F.floor(F.abs(x) * 100 + 0.5).cast("decimal(20,0)")
    baht = F.floor(satang / 100).cast("decimal(20,0)").cast("string")
    rest = F.lpad((satang % 100).cast("string"), 2, "0")
    high, low = F.substr(F.lpad(baht, 12, "0"), F.lit(1), F.lit(6)), F.right(F.lpad(baht, 12, "0"), F.lit(6))
    million = F.when(high == "000000", "").otherwise(F.concat(_thai_group(high), F.lit("ล้าน")))
    spoken = F.concat(million, _thai_group(low))
    amount = F.when(satang == 0, "ศูนย์บาท").when(spoken == "", "").otherwise(F.concat(spoken, F.lit("บาท")))
    tail = F.when(rest == "00", "ถ้วน").otherwise(F.concat(_thai_group(rest), F.lit("สตางค์")))
    return F.concat(F.when((x < 0) & (satang > 0), "ลบ").otherwise(""), amount, tail)
