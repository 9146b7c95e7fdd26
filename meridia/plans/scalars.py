"""Scalar functions over the tables: time arithmetic, cue text, URLs, ranges, labels."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import codecs, text, time
from .inputs import P, S, by_time, packets, samples, table
from .registry import register

QUERIES: dict = {}


def q(sql=None):
    return register(QUERIES, sql)


def _sql_text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _choice(rows: tuple, of: str, column: int) -> str:
    """SQL: the column of the row with number ``of``, as text."""
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN {_sql_text(r[column])}" for i, r in enumerate(rows)) + " END"


def _pick(rows: tuple, of, column: int):
    return F.get(F.array(*[F.lit(r[column]).cast("string") for r in rows]), of)


@q("SELECT l_orderkey AS k, l_partkey AS p, l_linenumber AS n, CAST(l_partkey - 1000 AS BIGINT) AS ticks, "
   "CAST(sign(l_partkey - 1000) * ((abs(l_partkey - 1000)::HUGEINT * 90000 * 2 + 44100) // 88200) AS BIGINT) AS nearest, "
   "CAST(floor_q AS BIGINT) AS low, CAST(-floor_m AS BIGINT) AS high FROM (SELECT *, ((l_partkey - 1000)::HUGEINT * 90000 - ((((l_partkey - 1000)::HUGEINT * 90000) % 44100) + 44100) % 44100) // 44100 AS floor_q, "
   "(-(l_partkey - 1000)::HUGEINT * 90000 - (((-(l_partkey - 1000)::HUGEINT * 90000) % 44100) + 44100) % 44100) // 44100 AS floor_m FROM lineitem)")
def prj1_timebase(spark, d):
    """PRJ-1: 1/44100 ticks in 90 kHz: nearest (halves away from zero), floor, ceiling; negatives are legal."""
    t = (F.col("l_partkey") - 1000).cast("long")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), F.col("l_linenumber").alias("n"), t.alias("ticks"),
        time.rescale(t, 1, 44100, 1, 90000).alias("nearest"), time.rescale_floor(t, 1, 44100, 1, 90000).alias("low"), time.rescale_ceil(t, 1, 44100, 1, 90000).alias("high"),
    )


@q("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'video' WHEN p_size % 3 = 1 THEN 'audio' ELSE 'subtitle' END AS kind, "
   "CASE WHEN p_size % 3 = 1 THEN CASE WHEN p_size % 2 = 0 THEN 48000 ELSE 44100 END ELSE 90000 END AS clock FROM part")
def prj2_output_clock(spark, d):
    """PRJ-2: video and subtitles on 90 kHz, audio on its sample rate."""
    kind = F.when(F.col("p_size") % 3 == 0, "video").when(F.col("p_size") % 3 == 1, "audio").otherwise("subtitle")
    clock = F.when(kind == "audio", F.when(F.col("p_size") % 2 == 0, 48000).otherwise(44100)).otherwise(90000)
    return table(spark, d, "part").select("p_partkey", kind.alias("kind"), clock.alias("clock"))


@q("SELECT doc_id, CASE lang WHEN 'en' THEN 'en-GB' WHEN 'fr' THEN 'fr' WHEN 'de' THEN 'de-AT' ELSE lang END AS language, octet_length(encode(trim(source))) AS n FROM documents")
def prj3_language(spark, d):
    """PRJ-3, PRJ-4: three-letter codes become two-letter ones, qualifiers stay; titles are trimmed."""
    code = F.when(F.col("lang") == "en", "ENG-GB").when(F.col("lang") == "fr", "fre").when(F.col("lang") == "de", "Deu-AT").otherwise(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", text.language(code).alias("language"), F.octet_length(text.title(F.col("source"))).cast("long").alias("n"))


#: a track's codec, the first bytes of its configuration, and how many bytes follow
CONFIGS = (
    ("h264", "01", 12), ("h264", "00000001", 12), ("h264", "0909000001674D", 8), ("h264", "00000109", 8), ("h264", "", 0), ("hevc", "01", 22), ("hevc", "01", 12), ("av1", "81", 3), ("av1", "81", 1), ("av1", "80", 3),
    ("aac", "", 2), ("aac", "F9", 1), ("aac", "00", 1), ("aac", "", 0), ("flac", "", 3), ("opus", "", 0), ("webvtt", "", 0), ("mov_text", "", 0), ("subrip", "", 0), ("hevc", "01", 30),
)
#: byte i of what follows; every fifth track has zeros from the eighth on
SEED = "CASE WHEN p_partkey % 5 = 0 AND {i} > 7 THEN 0 ELSE (p_partkey * ({i} * 37 + 11) + p_size * 7) % 256 END"
_N = max(x[2] for x in CONFIGS)
_HEX = f"(SELECT *, {_choice(CONFIGS, 'k', 0)} AS codec, {_choice(CONFIGS, 'k', 1)} || substr(" + " || ".join(f"printf('%02X', ({SEED.format(i=i)})::INT)" for i in range(_N)) + ", 1, 2 * CASE k " + " ".join(f"WHEN {i} THEN {x[2]}" for i, x in enumerate(CONFIGS)) + f" END) AS h FROM (SELECT p_partkey, p_size, p_partkey % {len(CONFIGS)} AS k FROM part))"


def _byte(i: int) -> str:
    return f"CAST('0x' || nullif(substr(h, {2 * i + 1}, 2), '') AS INTEGER)"


@q(f"""WITH x AS (SELECT *, length(h) // 2 AS n, {_byte(0)} AS a, {_byte(1)} AS b, {_byte(2)} AS c, {_byte(12)} AS level FROM {_HEX})
 SELECT p_partkey, CASE codec WHEN 'h264' THEN CASE WHEN n >= 4 AND a = 1 THEN 'avc1.' || lower(substr(h, 3, 6)) WHEN regexp_matches(h, '^(?:..)*?000001[02468ACE]7......') THEN 'avc1.' || lower(regexp_extract(h, '^(?:..)*?000001[02468ACE]7(......)', 1)) ELSE 'avc1' END
  WHEN 'hevc' THEN CASE WHEN n < 23 THEN 'hvc1' ELSE 'hvc1.' || ['', 'A', 'B', 'C'][b // 64 + 1] || b % 32 || '.' || printf('%X', CAST('0b' || reverse(lpad(bin(CAST('0x' || substr(h, 5, 8) AS BIGINT)), 32, '0')) AS BIGINT)) || '.' || CASE WHEN b // 32 % 2 = 1 THEN 'H' ELSE 'L' END || level || CASE WHEN p_partkey % 5 = 0 THEN regexp_replace(substr(h, 13, 6), '(..)', '.\\1', 'g') ELSE regexp_replace(substr(h, 13, 2 * greatest(0, {" , ".join(f"CASE WHEN substr(h, {13 + 2 * i}, 2) <> '00' THEN {i + 1} ELSE 0 END" for i in range(6))})), '(..)', '.\\1', 'g') END END
  WHEN 'av1' THEN CASE WHEN n >= 4 AND a = 129 AND b // 32 <= 2 AND (c // 32 % 2 = 0 OR (b // 32 = 2 AND c // 64 % 2 = 1)) THEN 'av01.' || b // 32 || '.' || printf('%02d', b % 32) || CASE WHEN c >= 128 THEN 'H' ELSE 'M' END || '.' || CASE WHEN c // 32 % 2 = 1 THEN '12' WHEN c // 64 % 2 = 1 THEN '10' ELSE '08' END END
  WHEN 'aac' THEN 'mp4a.40.' || CASE WHEN n = 0 OR a // 8 = 0 THEN 2 WHEN a // 8 = 31 AND n > 1 THEN 32 + a % 8 * 8 + b // 32 ELSE a // 8 END WHEN 'flac' THEN 'fLaC' WHEN 'opus' THEN 'opus' WHEN 'webvtt' THEN 'wvtt' WHEN 'mov_text' THEN 'tx3g' END AS codec FROM x""")
def prj5_rfc6381(spark, d):
    """PRJ-5: codec strings from decoder configurations: records, streams with start codes, short and wrong ones."""
    k = F.col("p_partkey") % len(CONFIGS)
    c = F.col
    seed = F.transform(F.sequence(F.lit(0), F.lit(_N - 1)), lambda i: F.lpad(F.hex(F.when((c("p_partkey") % 5 == 0) & (i > 7), 0).otherwise((c("p_partkey") * (i * 37 + 11) + c("p_size") * 7) % 256).cast("long")), 2, "0"))
    size = F.element_at(F.array(*[F.lit(x[2]) for x in CONFIGS]), (k + 1).cast("int"))
    config = F.unhex(F.concat(_pick(CONFIGS, k, 1), F.array_join(F.slice(seed, 1, size), "")))
    return table(spark, d, "part").select("p_partkey", codecs.codec_string(_pick(CONFIGS, k, 0), config).alias("codec"))


@q(f"WITH {P} SELECT arrival, '{{\"stream\":\"' || stream || '\",\"kind\":\"' || kind || '\",\"bytes\":\"' || bytes || '\"}}' AS body FROM p")
def prj6_lifecycle_body(spark, d):
    """PRJ-6: JSON bodies with 64-bit integers as strings."""
    body = F.to_json(F.struct(F.col("stream").cast("string").alias("stream"), "kind", F.col("bytes").cast("string").alias("bytes")))
    return packets(spark, d).select("arrival", body.alias("body"))


@q(f"WITH {S} SELECT arrival, CASE WHEN dur % 1000000000 = 0 THEN CAST(dur // 1000000000 AS VARCHAR) ELSE (dur // 1000000000) || '.' || rtrim(lpad(CAST(dur % 1000000000 AS VARCHAR), 9, '0'), '0') END AS seconds, "
   "greatest(1, (dur + 500000000) // 1000000000) AS target FROM s")
def fn1_decimal_seconds(spark, d):
    """FN-1, §1.2: durations as decimal seconds, and as whole target seconds."""
    return samples(spark, d).select("arrival", time.decimal_seconds("dur").alias("seconds"), time.target_seconds("dur").alias("target"))


@q(f"WITH {S}, m AS (SELECT arrival, dur // 1000000 AS ms FROM s) SELECT arrival, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS clock FROM m")
def fn2_cue_clock(spark, d):
    """FN-2: HH:MM:SS.mmm."""
    return samples(spark, d).select("arrival", time.clock(time.idiv("dur", 1_000_000).cast("long")).alias("clock"))


@q("SELECT conv_id, turn, CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN regexp_matches(t, '(^|\n)[ \t]*\n|\n[ \t]*$') THEN 'blank_line' END AS error, strlen(t) AS bytes, NOT contains(t, chr(10)) AND NOT contains(t, '-->') AND NOT contains(t, 'region:') AS setting "
   "FROM (SELECT *, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM conversations)")
def fn3_cue_text(spark, d):
    """FN-3, FN-4, FN-5, SRC-9: line ends, cue text checks, one-line settings."""
    c = F.col("text")
    n = text.newlines(c)
    return table(spark, d, "conversations").select("conv_id", "turn", text.cue_text_error(c).alias("error"), F.octet_length(n).cast("long").alias("bytes"), text.cue_setting_ok(n).alias("setting"))


#: markup round a text: (before, after) and what becomes of both, null where the cue is refused
SUBRIP = (
    ("<i>", "</i>", "<i>", "</i>"), ("<font color=red>", "</font>", "", ""), ("", " & x &amp; <", "", " &amp; x &amp; &lt;"), ("<b><i>", "</b></i>", None, None), ("{\\an8}", "", None, None),
    ("<B>", "</b>", "<b>", "</b>"), ("<b>", "", None, None), ("<s>", "</s>", "&lt;s&gt;", "&lt;/s&gt;"), ("1 < 2 > 0 ", "", "1 &lt; 2 &gt; 0 ", ""), ("</u>", "", None, None),
    ("<u class=x>", "<font><i></i></font></u>", "<u>", "<i></i></u>"), ("<i/>", "</i>", "<i>", "</i>"), ("&lt;&nbsp;&unknown;", "", "&lt;&nbsp;&amp;unknown;", ""),
)


@q(f"SELECT conv_id, turn, {_choice(SUBRIP, f'(conv_id * 7 + turn) % {len(SUBRIP)}', 2)} || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || {_choice(SUBRIP, f'(conv_id * 7 + turn) % {len(SUBRIP)}', 3)} AS vtt FROM conversations")
def fn6_subrip(spark, d):
    """FN-6: SubRip markup to WebVTT, a stack of open tags (Arrow batches)."""
    k = (F.col("conv_id") * 7 + F.col("turn")) % len(SUBRIP)
    odd = F.concat(_pick(SUBRIP, k, 0), "text", _pick(SUBRIP, k, 1))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([None if x is None else text.subrip_to_vtt(x) for x in b.column(2).to_pylist()], pa.string())], names=["conv_id", "turn", "vtt"])

    return table(spark, d, "conversations").select("conv_id", "turn", odd.alias("t")).mapInArrow(run, "conv_id long, turn long, vtt string")


@q("SELECT page_id, url_decode(replace(url, '+', '%2B')) AS decoded, string_split(regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '^/', ''), '/') AS parts, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page FROM pages WHERE NOT regexp_matches(url, '%([^0-9A-Fa-f]|$)') AND NOT list_has_any(string_split(regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '^/', ''), '/'), ['', '.', '..'])")
def fn7_url_parts(spark, d):
    """FN-7, FN-8, FN-10: strict percent decoding, path components, a query's value."""
    path = F.regexp_extract("url", "://([^?#]*)", 1)
    rows = table(spark, d, "pages").select("page_id", text.percent_decode(F.col("url")).alias("decoded"), text.path_parts(path).alias("parts"), F.coalesce(text.first_value(F.regexp_extract("url", r"\?([^#]*)", 1), "page"), F.lit("")).alias("page"))
    return rows.where("decoded is not null and parts is not null")


#: query strings: what stands before and after a number, and whether each of three directives is that number or a text
QUERY = (
    ("_HLS_msn=", "", "#", None, None), ("x=1&_HLS_msn=99&_HLS_part=", "&_HLS_msn=3", "3", "#", None), ("_HLS_skip=YES&_HLS_msn=", "&_HLS_skip=v2", "#", None, "v2"), ("", "", None, None, None),
    ("_hls_msn=", "&_HLS_MSN=1", None, None, None), ("_HLS_msn=1&_HLS_msn=", "&_HLS_part=", "#", "", None), ("a&b&_HLS_part=", "&&", None, "#", None), ("_HLS_msnx=1&x_HLS_msn=", "", None, None, None),
    ("_HLS_msn=5&_HLS_skip=", "", "5", None, "#"), ("_HLS_part=7&_HLS_msn=", "&_HLS_part=8", "#", "8", None), ("_HLS_msn", "=", None, None, None),
)


def _directive(column: int) -> str:
    return f"replace({_choice(QUERY, f'o_orderkey % {len(QUERY)}', column)}, '#', CAST(o_custkey AS VARCHAR))"


@q(f"SELECT o_orderkey, CASE WHEN o_orderkey % {len(QUERY)} = 10 THEN NULL ELSE {_directive(2)} END AS msn, {_directive(3)} AS part, {_directive(4)} AS skip FROM orders")
def fn9_directives(spark, d):
    """FN-9: playlist directives; unknown ones are ignored, names count as they are written, and the last of a name counts."""
    k = F.col("o_orderkey") % len(QUERY)
    query = F.concat(_pick(QUERY, k, 0), F.when(~k.isin(3), F.col("o_custkey").cast("string")).otherwise(""), _pick(QUERY, k, 1))
    return table(spark, d, "orders").select("o_orderkey", *[text.directive(query, f"_HLS_{n}").alias(n) for n in ("msn", "part", "skip")])


@q("SELECT o_orderkey, CASE WHEN m = 3 OR (m = 0 AND b < a) THEN 'ignore' WHEN (m IN (0, 1) AND a >= 500) OR (m = 2 AND a = 0) THEN 'unsatisfiable' ELSE 'satisfiable' END AS kind, "
   "CASE WHEN m = 3 OR (m = 0 AND b < a) OR (m IN (0, 1) AND a >= 500) OR (m = 2 AND a = 0) THEN NULL WHEN m = 2 THEN greatest(500 - a, 0) ELSE a END AS first, "
   "CASE WHEN m = 3 OR (m = 0 AND b < a) OR (m IN (0, 1) AND a >= 500) OR (m = 2 AND a = 0) THEN NULL WHEN m = 0 THEN least(b, 499) ELSE 499 END AS last "
   "FROM (SELECT o_orderkey, o_orderkey % 4 AS m, o_custkey % 700 AS a, (o_custkey * 7) % 700 AS b FROM orders)")
def fn11_range(spark, d):
    """FN-11: Range headers against a body of 500 bytes."""
    k, a, b = F.col("o_orderkey") % 4, (F.col("o_custkey") % 700).cast("string"), (F.col("o_custkey") * 7 % 700).cast("string")
    h = F.when(k == 0, F.concat(F.lit("bytes="), a, F.lit("-"), b)).when(k == 1, F.concat(F.lit("bytes="), a, F.lit("-"))).when(k == 2, F.concat(F.lit("bytes=-"), a)).otherwise(F.concat(F.lit("items="), a, F.lit("-")))
    return table(spark, d, "orders").select("o_orderkey", text.byte_range(h, F.lit(500).cast("long")).alias("r")).select("o_orderkey", "r.*")


#: headers, and whether they accept gzip
ACCEPT = (
    ("gzip, br", 1), ("br", 0), ("gzip;q=0.5", 1), ("gzip;q=0, *", 0), ("*", 1), ("*;q=0", 0), ("", 0), ("GZIP", 1), ("br;q=1.0 , gzip ; q=0.001", 1), ("gzip;q=0.000", 0),
    ("identity;q=1, *;q=0.1", 1), ("xgzip", 0), ("deflate,gzip", 1), ("gzip;q=0,gzip;q=1", 0),
)


@q(f"SELECT o_orderkey, o_orderkey % {len(ACCEPT)} IN ({', '.join(str(i) for i, x in enumerate(ACCEPT) if x[1])}) AS gzip FROM orders")
def fn14_accept_gzip(spark, d):
    """FN-14: Accept-Encoding: the first entry that names gzip decides, else one for all; its quality must not be 0."""
    h = _pick(ACCEPT, F.col("o_orderkey") % len(ACCEPT), 0)
    return table(spark, d, "orders").select("o_orderkey", text.accepts_gzip(h).alias("gzip"))


@q("SELECT page_id, replace(replace(replace(html, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n') AS label FROM pages")
def fn15_escape(spark, d):
    """FN-15: label values."""
    return table(spark, d, "pages").select("page_id", text.escape_label(F.col("html")).alias("label"))


#: templates, and their values where SRC is the document's source, EMPTY is empty and NONE is not defined
TEMPLATES = (
    ("$${a} ${SRC} ${NONE:-other} $1", "${a} {SRC} other $1"), ("${EMPTY:-d}${SRC}", "d{SRC}"), ("${EMPTY}x", "x"), ("$", "$"), ("$$$$", "$$"), ("a${SRC:-b}c", "a{SRC}c"), ("${NONE:-}", ""),
    ("${NONE:-${SRC}", "${SRC"), ("é${SRC}$", "é{SRC}$"), ("${NONE}", None), ("${SRC", None), ("$ {SRC}", "$ {SRC_}"),
)


@q(f"SELECT doc_id, replace(replace({_choice(TEMPLATES, f'doc_id % {len(TEMPLATES)}', 1)}, '{{SRC}}', source), '{{SRC_}}', '{{SRC}}') AS value FROM documents")
def fn16_interpolate(spark, d):
    """FN-16: configuration interpolation, over templates in Arrow batches; null where a name is undefined or a brace open."""
    def value(template: str, source: str | None) -> str | None:
        try:
            return text.interpolate(template, {"SRC": source, "EMPTY": ""})
        except ValueError:
            return None

    def run(batches):
        for b in batches:
            got = [value(t, s) for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string())], names=["doc_id", "value"])

    rows = table(spark, d, "documents").select("doc_id", _pick(TEMPLATES, F.col("doc_id") % len(TEMPLATES), 0).alias("t"), "source")
    return rows.mapInArrow(run, "doc_id long, value string")


@q("SELECT p_partkey, CAST(a // gcd(a, 100) AS BIGINT) AS num, CAST(100 // gcd(a, 100) AS BIGINT) AS den FROM (SELECT p_partkey, (p_size * 100 + p_partkey % 100)::BIGINT AS a FROM part) WHERE a > 0")
def fn18_pace(spark, d):
    """FN-18: paces such as 1.50x as reduced fractions."""
    s = F.concat(F.col("p_size").cast("string"), F.lit("."), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), F.lit("x"))
    return table(spark, d, "part").select("p_partkey", text.pace(s).alias("f")).where("f is not null").select("p_partkey", "f.num", "f.den")


#: Retry-After headers and the seconds they ask for
AFTER = ((None, None), ("5", "5"), ("120", "120"), ("abc", None), ("-1", None), ("0", "0"), (" 7 ", "7"), ("1.5", None), ("", None), ("+9", "9"), ("Wed, 21 Oct 2015 07:28:00 GMT", None))


@q(f"WITH {P}, x AS (SELECT arrival, 200 + bytes % 400 AS status, (row_number() OVER (PARTITION BY stream ORDER BY t, arrival) - 1) % 12 AS attempt, CAST({_choice(AFTER, f'arrival % {len(AFTER)}', 1)} AS BIGINT) AS asked FROM p) SELECT arrival, CASE WHEN status < 300 THEN 'delivered' WHEN status IN (408, 425, 429) OR status >= 500 THEN 'retry' ELSE 'reject' END AS verdict, CASE WHEN status IN (408, 425, 429) OR status >= 500 THEN CAST(least(60, coalesce(asked, pow(2, attempt))) AS BIGINT) END AS wait FROM x")
def fn19_retry(spark, d):
    """FN-19, FN-20: verdicts by status, and waits that double under a cap of 60, or are what the endpoint asks for."""
    status = F.lit(200) + F.col("bytes") % 400
    attempt = (F.row_number().over(by_time()) - 1) % 12
    verdict = F.when(F.col("status") < 300, "delivered").when(F.col("status").isin(408, 425, 429) | (F.col("status") >= 500), "retry").otherwise("reject")
    wait = text.retry_wait(F.col("attempt"), _pick(AFTER, F.col("arrival") % len(AFTER), 0))
    return packets(spark, d).select("arrival", status.alias("status"), attempt.alias("attempt")).select("arrival", verdict.alias("verdict"), F.when(verdict == "retry", wait).alias("wait"))


#: stream ids with # for a number, and their form, namespace, name and credential
STREAM_IDS = (
    ("#!::u=me,r=live/#,m=publish", "structured", "live", "#", "me"), ("#!::r=#,u=k=#", "structured", None, "#", "k=#"), ("#!::r=#,m=publish", None, None, None, None), ("#!::u=a,r=#,m=request", None, None, None, None),
    ("#!::u=a,r=#,r=#", None, None, None, None), ("#!::u=a,r=#,x=1", None, None, None, None), ("#!::u=a,r=#,h=,s=1", None, None, None, None), ("#!::u=a,r=a/b/#,h=x,s=1,custom=é,t=stream", "structured", "a/b", "#", "a"),
    ("#!::u=a,r=#,t=file", None, None, None, None), ("#!:u=a,r=#", None, None, None, None), ("publish:#", "compact", None, "#", "#"), ("publish:live/#:user:pa:ss", "compact", "live", "#", "user:pa:ss"),
    ("publish::#", None, None, None, None), ("publish:#:", None, None, None, None), ("publish:/#:k", None, None, None, None), ("publish:#/:k", None, None, None, None), ("read:#", None, None, None, None), ("request:#", None, None, None, None),
    ("live/#", "bare", None, "live/#", "live/#"), ("Publish:#", "bare", None, "Publish:#", "Publish:#"), ("#!::", None, None, None, None), ("#!::u=a,,r=#", None, None, None, None), ("#!::u=a,r=#,U=2", None, None, None, None),
)


def _id_part(column: int) -> str:
    return f"replace({_choice(STREAM_IDS, 'k', column)}, '#', CAST(c_custkey AS VARCHAR))"


@q(f"SELECT c_custkey, {_choice(STREAM_IDS, 'k', 1)} AS form, {_id_part(2)} AS namespace, {_id_part(3)} AS name, {_id_part(4)} AS credential FROM (SELECT c_custkey, c_custkey % {len(STREAM_IDS)} AS k FROM customer)")
def fn24_stream_id(spark, d):
    """FN-24: publishers' stream ids in three forms, and those refused."""
    raw = _pick(STREAM_IDS, F.col("c_custkey") % len(STREAM_IDS), 0)
    number = F.col("c_custkey").cast("string")
    s = F.when(raw.startswith("#!:"), F.concat(F.lit("#!:"), F.replace(F.substring(raw, 4, 1000), F.lit("#"), number))).otherwise(F.replace(raw, F.lit("#"), number))
    return table(spark, d, "customer").select("c_custkey", text.stream_id(s).alias("x")).select("c_custkey", "x.form", "x.namespace", "x.name", "x.credential")


@q("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'audio/' ELSE 'pid/' END || p_partkey AS key, lower(hex(p_brand)) AS hexed, p_brand AS back, greatest(1, (48000 + p_partkey) // (p_partkey + 1)) AS quantum FROM part")
def fn25_identity(spark, d):
    """FN-25, FN-26, SUP-16: identity keys, hex there and back, the timestamp quantum."""
    hexed = F.lower(F.hex("p_brand"))
    key = F.concat(F.when(F.col("p_size") % 2 == 0, "audio/").otherwise("pid/"), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select("p_partkey", key.alias("key"), hexed.alias("hexed"), F.decode(F.unhex(hexed), "utf-8").alias("back"), time.quantum(F.lit(1), F.col("p_partkey") + 1, F.lit(1), F.lit(48000)).alias("quantum"))


#: names of recordings; those with empty, dot or climbing components are refused
NAMES = (("live", 1), ("..", 0), ("a/../b", 0), (".", 0), ("", 0), ("a//b", 0), ("..a", 1), ("a..", 1), ("/etc", 0), ("a/./b", 0), ("...", 1), (".hidden/x", 1), ("a/", 0), ("é/ü", 1))


@q(f"WITH {P} SELECT arrival, {_choice(NAMES, f'arrival % {len(NAMES)}', 0)} || '/' || stream || '/' || strftime(make_timestamp(t // 1000), '%Y-%m-%d') || '.mp4' AS path FROM p WHERE kind <> 'error' AND arrival % {len(NAMES)} IN ({', '.join(str(i) for i, x in enumerate(NAMES) if x[1])})")
def snk3_path(spark, d):
    """SNK-3: recording paths from a pattern; unsafe components are refused."""
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), time.floor_div(F.col("t"), 86400 * 10**9).cast("int")), "yyyy-MM-dd")
    path = F.concat(_pick(NAMES, F.col("arrival") % len(NAMES), 0), F.lit("/"), F.col("stream").cast("string"), F.lit("/"), day, F.lit(".mp4"))
    return packets(spark, d).where("kind <> 'error'").select("arrival", path.alias("path")).where(~F.col("path").rlike(r"(^|/)\.{0,2}(/|$)"))
