"""Text functions of cues, paths, queries, ranges and labels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: ISO 639-2 bibliographic codes and what they stand for in ISO 639-1
LANGUAGES = {"eng": "en", "fre": "fr", "fra": "fr", "ger": "de", "deu": "de", "spa": "es", "ita": "it", "jpn": "ja", "chi": "zh", "zho": "zh", "kor": "ko", "por": "pt", "rus": "ru", "dut": "nl", "nld": "nl"}


def newlines(c: Column) -> Column:
    """CRLF and CR become LF."""
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def cue_text_error(c: Column) -> Column:
    """Why a cue's text is refused, or null: empty, nul, blank_line."""
    n = newlines(c)
    return F.when(n.isNull() | (n == ""), "empty").when(F.instr(n, "\x00") > 0, "nul").when(n.rlike(r"(^|\n)[ \t]*\n|\n[ \t]*$"), "blank_line")


def cue_setting_ok(c: Column) -> Column:
    """One line, without ``-->`` and without ``region:``."""
    return ~c.contains("\n") & ~c.contains("\r") & ~c.contains("-->") & ~c.contains("region:")


def language(c: Column) -> Column:
    """The primary subtag in lower case and its shortest code; qualifiers stay."""
    primary = F.lower(F.regexp_extract(c, "^[^-]*", 0))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.concat(F.coalesce(F.element_at(table, primary), primary), F.regexp_extract(c, "-.*$", 0))


def title(c: Column) -> Column:
    """Trimmed; null if empty, above 256 bytes, or holding a quote or control character."""
    t = F.trim(c)
    return F.when((t != "") & (F.octet_length(t) <= 256) & ~t.rlike('["\\x00-\\x1f\\x7f]'), t)


def percent_decode(c: Column) -> Column:
    """Strict: null where a % is not followed by two hex digits."""
    return F.when(~c.rlike("%(?![0-9A-Fa-f]{2})"), F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))))


def path_parts(c: Column) -> Column:
    """The components of a viewer path, or null: at most 2,048 bytes and 32 components, no empty or dot segment."""
    parts = F.split(F.regexp_replace(c, "^/", ""), "/")
    bad = F.exists(parts, lambda p: (p == "") | (p == ".") | (p == ".."))
    return F.when((F.octet_length(c) <= 2048) & (F.size(parts) <= 32) & ~bad, parts)


def directive(query: Column, name: str) -> Column:
    """The last value of a query's parameter; null if absent."""
    got = F.regexp_extract_all(query, F.lit(f"(?:^|&){name}=([^&]*)"), F.lit(1))
    return F.try_element_at(got, F.lit(-1))


def first_value(query: Column, name: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(query, F.lit(f"(?:^|&){name}=([^&]*)"), F.lit(1)), F.lit(1))


def byte_range(header: Column, size: Column) -> Column:
    """struct(kind, first, last) of a Range header: ignore, satisfiable or unsatisfiable; ends are clamped."""
    a, b = (F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", i) for i in (1, 2))
    ok = header.rlike(r"^bytes=(\d+-\d*|-\d+)$")
    first, last, suffix = F.try_to_number(a, F.lit("9" * 18)).cast("long"), F.try_to_number(b, F.lit("9" * 18)).cast("long"), a == ""
    lo = F.when(suffix, F.greatest(size - last, F.lit(0))).otherwise(first)
    hi = F.when(suffix, size - 1).otherwise(F.least(F.coalesce(last, size - 1), size - 1))
    kind = (
        F.when(~F.coalesce(ok, F.lit(False)) | (~suffix & (last < first)), "ignore")
        .when((suffix & (last == 0)) | (size == 0) | (lo >= size), "unsatisfiable").otherwise("satisfiable")
    )
    return F.struct(kind.alias("kind"), F.when(kind == "satisfiable", lo).alias("first"), F.when(kind == "satisfiable", hi).alias("last"))


def accepts_gzip(c: Column) -> Column:
    """The first gzip entry decides, q=0 refuses, * is the fallback, absent is no."""
    entry = lambda name: F.try_element_at(F.regexp_extract_all(F.lower(c), F.lit(rf"(?:^|,)\s*{name}\s*((?:;[^,]*)?)"), F.lit(1)), F.lit(1))
    some = F.coalesce(entry("gzip"), entry(r"\*"))
    return F.coalesce(some.isNotNull() & ~some.rlike(r";\s*q\s*=\s*0(\.0*)?\s*$"), F.lit(False))


def escape_label(c: Column) -> Column:
    """Backslash, quote and line feed of a label value."""
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def pace(c: Column) -> Column:
    """struct(num, den) of ``1.5x``: reduced, at most nine fractional digits, not zero; else null."""
    whole, part = F.regexp_extract(c, r"^(\d{1,9})(?:\.(\d{1,9}))?x$", 1), F.regexp_extract(c, r"^(\d{1,9})(?:\.(\d{1,9}))?x$", 2)
    num, den = F.concat(whole, part).cast("long"), F.rpad(F.lit("1"), 1, "0")
    den = F.rpad(F.lit("1"), F.length(part) + 1, F.lit("0")).cast("long")
    # the common divisor of num and a power of ten: twos and fives
    def strip(x: Column, p: int) -> Column:
        return F.greatest(*[F.when((num % p**k == 0) & (den % p**k == 0), F.lit(p**k)).otherwise(1) for k in range(10)])
    g = strip(num, 2) * strip(num, 5)
    return F.when((whole != "") & (num > 0), F.struct((num / g).cast("long").alias("num"), (den / g).cast("long").alias("den")))


def stream_id(c: Column, longest: int = 512) -> Column:
    """struct(form, namespace, name, credential) of a publisher's stream id of at most ``longest`` bytes, or
    null where it is refused.

    ``publish:resource[:credential]``, where the resource is its own credential if there is no other;
    ``#!::key=value,...`` with a user (the credential) and a resource, no repeats, no empty parts, no
    one-letter key that is not known, and no other mode or type than publish and stream; or a bare
    name. What precedes a resource's last slash is its namespace."""
    none = F.lit(None).cast("string")

    def found(form: str, resource: Column, credential: Column) -> Column:
        slash = resource.contains("/")
        space, name = F.regexp_extract(resource, "^(.*)/[^/]*$", 1), F.regexp_extract(resource, "([^/]*)$", 1)
        fine = (resource != "") & (credential != "") & (~slash | ((space != "") & (name != "")))
        return F.when(fine, F.struct(F.lit(form).alias("form"), F.when(slash, space).alias("namespace"), name.alias("name"), credential.alias("credential")))

    rest = F.substring(c, 9, 1 << 30)
    first = F.regexp_extract(rest, "(?s)^([^:]*)", 1)
    compact = found("compact", first, F.when(rest.contains(":"), F.regexp_extract(rest, "(?s)^[^:]*:(.*)$", 1)).otherwise(rest))
    fields = F.split(F.substring(c, 5, 1 << 30), ",", -1)
    keys = F.transform(fields, lambda x: F.regexp_extract(x, "(?s)^([^=]+)=.+$", 1))
    value = lambda k: F.regexp_extract(F.try_element_at(F.filter(fields, lambda x: x.startswith(k + "=")), F.lit(1)), "(?s)=(.*)$", 1)
    bad = F.array_contains(keys, "") | (F.size(F.array_distinct(keys)) < F.size(keys)) | F.exists(keys, lambda k: (F.octet_length(k) == 1) & ~k.isin("r", "m", "u", "h", "s", "t"))
    mode, kind = F.coalesce(value("m"), F.lit("publish")), F.coalesce(value("t"), F.lit("stream"))
    structured = F.when(~bad & (mode == "publish") & (kind == "stream"), found("structured", value("r"), value("u")))
    bare = F.struct(F.lit("bare").alias("form"), none.alias("namespace"), c.alias("name"), c.alias("credential"))
    refused = (c == "") | c.rlike("^(read:|request:|#!:)") | (F.octet_length(c) > longest)
    return F.when(c.startswith("#!::") & (F.octet_length(c) <= longest), structured).when(refused, None).when(c.startswith("publish:"), compact).when(c.isNotNull(), bare)


def retry_wait(attempt: Column, header: Column, first: int = 1, longest: int = 60) -> Column:
    """Seconds to wait after an attempt (from 0): what a Retry-After header asks for, else ``first`` doubled
    each time, both at most ``longest``. Headers that are no whole seconds ask for nothing."""
    digits = F.regexp_extract(F.trim(header), r"^\+?([0-9]{1,18})$", 1)
    asked = F.when(digits != "", digits).cast("long")
    doubled = F.least(F.pow(F.lit(2), F.least(attempt, F.lit(40))) * first, F.lit(longest)).cast("long")
    return F.least(F.coalesce(asked, doubled), F.lit(longest).cast("long"))


def interpolate(text: str, env: dict) -> str:
    """${VAR}, ${VAR:-x} (unset or empty), $$; a lone $ stays. Undefined or unclosed: ValueError."""
    out, i = [], 0
    while i < len(text):
        if text.startswith("$$", i):
            out.append("$")
            i += 2
        elif text.startswith("${", i):
            end = text.find("}", i)
            if end < 0:
                raise ValueError("unclosed ${")
            name, given, other = text[i + 2 : end].partition(":-")
            value = env.get(name)
            if not value and given:
                value = other
            if value is None:
                raise ValueError(f"undefined {name}")
            out.append(value)
            i = end + 1
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def subrip_to_vtt(text: str) -> str | None:
    """SubRip markup as WebVTT: balanced b, i and u stay, font goes, other text is escaped; ``{\\`` is refused."""
    import re

    if "{\\" in text:
        return None
    out, open_tags = [], []
    for piece in re.split(r"(</?[A-Za-z][^<>]*>)", text):
        m = re.fullmatch(r"<(/?)([A-Za-z]+)[^<>]*>", piece)
        name = m[2].lower() if m else ""
        if not m:
            out.append(re.sub(r"&(?!amp;|lt;|gt;|nbsp;|lrm;|rlm;)", "&amp;", piece).replace("<", "&lt;").replace(">", "&gt;"))
        elif name == "font":
            continue
        elif name not in ("b", "i", "u"):
            out.append(piece.replace("<", "&lt;").replace(">", "&gt;"))
        elif not m[1]:
            open_tags.append(name)
            out.append(f"<{name}>")
        elif open_tags and open_tags[-1] == name:
            open_tags.pop()
            out.append(f"</{name}>")
        else:
            return None
    return None if open_tags else "".join(out)


def attribute_list(attributes: list[tuple[str, Column, bool]]) -> Column:
    """NAME=value,... of (name, value, quoted): null values are left out; a quoted one that holds a quote
    or a line's end makes the whole list null."""
    out, bad = [], F.lit(False)
    for name, value, quoted in attributes:
        if quoted:
            bad = bad | F.coalesce(value.rlike('["\\n\\r]'), F.lit(False))
            value = F.concat(F.lit('"'), value, F.lit('"'))
        out.append(F.concat(F.lit(name + "="), value))
    return F.when(~bad, F.concat_ws(",", *out))


def proxy_header(line: Column) -> Column:
    """A text PROXY header as (address, port, error): one space between six fields, a whole address of
    the stated family, a port of 16 bits. The address of UNKNOWN ones is the peer's, told as 'peer'."""
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    group = "[0-9A-Fa-f]{1,4}"
    v6 = f"(?=[0-9A-Fa-f:]+$)(?:(?:{group}:){{7}}{group}|(?=(?:[0-9A-Fa-f]*:){{2,7}}[0-9A-Fa-f]*$)(?!.*::.*::)(?!.*:::)(?:{group})?(?::{group})*::(?:{group}:)*(?:{group})?)"
    f = F.split(line, " ", -1)
    family, source, port = (F.get(f, F.lit(i)) for i in (1, 2, 4))
    fits = ((family == "TCP4") & source.rlike(f"^(?:{octet}\\.){{3}}{octet}$")) | ((family == "TCP6") & source.rlike(f"^{v6}$"))
    number = F.when(port.rlike(r"^\+?[0-9]{1,9}$"), port.cast("int"))
    ok = F.coalesce((F.size(f) == 6) & (F.get(f, F.lit(0)) == "PROXY") & fits & (number <= 65535), F.lit(False))
    unknown = F.coalesce(line.startswith("PROXY UNKNOWN ") | (line == "PROXY UNKNOWN"), F.lit(False))
    return F.struct(
        F.when(unknown, F.lit("peer")).when(ok, source).alias("address"), F.when(~unknown & ok, number).alias("port"), F.when(~unknown & ~ok, "malformed").alias("error")
    )
