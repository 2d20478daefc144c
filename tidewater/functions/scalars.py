"""Scalar functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import base64
import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- paths and requests -------------------------------------------------------------------------------------------


def normalize_path(path: str) -> str:
    """Both kinds of slash, no empty or dot parts, no slash at the end; the root is '/'."""
    return "/" + posixpath.normpath("/" + path.replace("\\", "/")).lstrip("/") if path else "/"


def prefix_upper_bound(prefix: str) -> str | None:
    """The smallest string after all strings with a prefix; none if there is none. UTF-8 sorts by bytes as by code points."""
    while prefix:
        code = ord(prefix[-1]) + 1
        if code <= 0x10FFFF:
            return prefix[:-1] + chr(0xE000 if code == 0xD800 else code)
        prefix = prefix[:-1]
    return None


def has_prefix(column: Column, prefix: str) -> Column:
    """A half-open range, which Parquet statistics can prune."""
    high = prefix_upper_bound(prefix)
    return (column >= prefix) & (column < high) if high is not None else column >= prefix


def encode_cursor(offset: int) -> str:
    return base64.b64encode(str(offset).encode()).decode()


def decode_cursor(cursor: str) -> int:
    """0 for anything that is no cursor."""
    try:
        return max(0, int(base64.b64decode(cursor, validate=True)))
    except ValueError:
        return 0


def clamp_k(k: int) -> int:
    """Up to 0: 20; over 100: 100."""
    return 20 if k <= 0 else min(k, 100)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    return F.when(path.rlike("^/[^/]*$"), F.lit("/")).otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def glob_to_regex(glob: str) -> str:
    """'*' and '?' stay within a path part, '**' doesn't; '**/x' also means x at the root."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and "]" in glob[i + 1 :]:
            j = glob.index("]", i + 1)
            out, i = out + "[" + glob[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        elif glob[i] == "{" and "}" in glob[i:]:
            j = glob.index("}", i)
            out, i = out + "(?:" + "|".join(map(re.escape, glob[i + 1 : j].split(","))) + ")", j + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def matches_globs(path: Column, include: list[str], exclude: list[str]) -> Column:
    """No include globs: everything is in. Exclude globs win."""
    inside = F.lit(True)
    if include:
        inside = F.lit(False)
        for g in include:
            inside = inside | path.rlike(glob_to_regex(g))
    for g in exclude:
        inside = inside & ~path.rlike(glob_to_regex(g))
    return inside


# ---- content ----------------------------------------------------------------------------------------------------

#: Extensions of each class.
CLASS_EXTENSIONS = {
    "code": (".py", ".go", ".js", ".ts", ".rs", ".java", ".c", ".cc", ".cpp", ".h", ".hpp"),
    "document": (".md", ".txt", ".rst", ".org", ".tex", ".pdf", ".docx", ".odt"),
    "image": (".png", ".jpg", ".jpeg", ".gif", ".webp", ".heic", ".tiff"),
    "media": (".mp4", ".mkv", ".mov", ".avi", ".mp3", ".wav", ".flac", ".ogg", ".webm"),
    "data": (".csv", ".tsv", ".json", ".yaml", ".yml", ".xml", ".sqlite"),
}
BINARY_DOCUMENT = r"[.](pdf|docx|odt)$"


def is_binary(content: Column) -> Column:
    """Whether a NUL byte occurs."""
    return F.position(F.lit(b"\x00"), content) > 0


def mime_of(sample: Column) -> Column:
    """MIME type by the first bytes."""
    head = F.hex(F.substring(sample, 1, 16))
    text = F.lower(F.trim(F.substring(sample, 1, 64).cast("string")))
    out = F.when(F.length(sample) == 0, "text/plain; charset=utf-8")
    for magic, mime in (("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("255044462D", "application/pdf"), ("504B0304", "application/zip"), ("1F8B08", "application/x-gzip"), ("4F67675300", "application/ogg"), ("494433", "audio/mpeg"), ("1A45DFA3", "video/webm"), ("424D", "image/bmp")):
        out = out.when(head.startswith(magic), mime)
    out = out.when(head.rlike("^52494646.{8}57454250"), "image/webp").when(head.rlike("^52494646.{8}57415645"), "audio/wave").when(head.rlike("^.{8}66747970"), "video/mp4")
    out = out.when(text.rlike("^(<!doctype html|<html|<head|<body|<script|<table|<div|<p>|<!--)"), "text/html; charset=utf-8").when(text.startswith("<?xml"), "text/xml; charset=utf-8")
    odd = F.hex(F.substring(sample, 1, 512)).rlike("^(?:..)*?(?:0[0-8B]|0[EF]|1[0-9CDEF])")
    return out.when(odd, "application/octet-stream").otherwise("text/plain; charset=utf-8")


def content_class(path: Column, mime: Column | None = None, sample: Column | None = None) -> Column:
    """Class by extension, else by MIME type; code and documents with NUL bytes are unknown, binary documents excepted."""
    ext = F.lower(extension(path))
    out = F.when(F.lit(False), "")
    for name, extensions in CLASS_EXTENSIONS.items():
        out = out.when(ext.isin(*extensions), name)
    if mime is not None:
        out = out.when(mime.startswith("text/"), "document").when(mime.startswith("image/"), "image").when(mime.startswith("video/") | mime.startswith("audio/"), "media")
    out = out.otherwise("unknown")
    if sample is None:
        return out
    return F.when(is_binary(sample) & ((out == "code") | (out == "document") & ~F.lower(path).rlike(BINARY_DOCUMENT)), "unknown").otherwise(out)


def content_hash(content: Column, tagged: bool = False) -> Column:
    h = F.sha2(content.cast("binary"), 256)
    return F.concat(F.lit("sha256:"), h) if tagged else h


def verify_hash(content: Column, tagged: Column) -> Column:
    return F.lower(tagged) == content_hash(content, True)


# ---- text -----------------------------------------------------------------------------------------------------

#: Credentials, in the order in which they are replaced.
SECRETS = (
    r"AKIA[0-9A-Z]{16}",
    r"(?i)(?:aws_secret_access_key|secret_key)\s*[:=]\s*[A-Za-z0-9/+=]{40}",
    r"(?i)(?:api[_-]?key|apikey)\s*[:=]\s*\S{10,}",
    r"ghp_[A-Za-z0-9]{20,}",
    r"github_pat_[A-Za-z0-9_]{20,}",
    r"sk-[A-Za-z0-9_-]{20,}",
    r"-----BEGIN\s+\S*\s*PRIVATE KEY-----",
    r"[A-Za-z0-9_-]{40,}",
)


#: What a text must hold, in lower case, for a pattern of SECRETS to find anything: a look that costs next to nothing.
HINTS = ("akia", "secret", "key", "ghp_", "github_pat_", "sk-", "private key-----", None)


def redact(text: Column, most: int | None = None) -> Column:
    """Credentials and long runs become [REDACTED]; then a cut at so many bytes, back at a character's boundary, with a remark."""
    low = F.lower(text)
    hinted = {h: F.contains(low, F.lit(h)) for h in HINTS if h}
    out = text
    for p, h in zip(SECRETS, HINTS):
        replaced = F.regexp_replace(out, p, "[REDACTED]")
        out = F.when(hinted[h], replaced).otherwise(out) if h else replaced
    return out if most is None else truncate_bytes(out, most, f"... [output truncated at {most} bytes]")


def truncate_bytes(text: Column, most: int, suffix: str) -> Column:
    """Texts over so many bytes are cut, before a character that doesn't fit as a whole, and get a suffix."""
    head = F.hex(F.substring(text.cast("binary"), 1, most + 1))
    whole = F.regexp_replace(head, "(?:[C-F].)?(?:[89AB].)*$|..$", "")  # the character that the cut falls into, or the one after it
    return F.when(F.octet_length(text) > most, F.concat(F.unhex(whole).cast("string"), F.lit(suffix))).otherwise(text)


def truncate_chars(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def mask_key(key: Column) -> Column:
    return F.when(F.char_length(key) > 11, F.concat(F.left(key, F.lit(7)), F.repeat(F.lit("*"), F.char_length(key) - 11), F.right(key, F.lit(4)))).otherwise(F.repeat(F.lit("*"), F.char_length(key)))


def format_size(n: Column) -> Column:
    """One decimal, a half to the even digit: 1280 bytes are 1.2 KB."""
    return (
        F.when(n >= 1024 * 1024, F.format_string("%.1f MB", F.bround(n / (1024 * 1024), 1)))
        .when(n >= 1024, F.format_string("%.1f KB", F.bround(n / 1024, 1)))
        .otherwise(F.format_string("%d B", n))
    )


def strip_controls(text: Column) -> Column:
    """Without control, bidirectional and line-separator characters."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x9F‎‏ -‮⁦-⁩]", "")


def workspace_hash(path: Column) -> Column:
    return F.left(F.sha2(path, 256), F.lit(12))


def json_equal(a: Column, b: Column) -> Column:
    """The same value whatever the order of keys; strings that are no JSON are compared as they are. Empty means {}."""
    a, b = (F.when(F.coalesce(x, F.lit("")) == "", "{}").otherwise(x) for x in (a, b))
    x, y = (F.to_json(F.try_parse_json(v)) for v in (a, b))
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(a == b)


# ---- tools ----------------------------------------------------------------------------------------------------

#: Words in a function's name, in the order in which they decide.
RISK_WORDS = (
    ("destructive", ("delete", "remove", "drop", "destroy", "purge", "truncate")),
    ("side_effects", ("send", "write", "update", "create", "insert", "post", "put", "push", "deploy", "execute", "run", "modify", "set", "notify")),
    ("network", ("fetch", "download", "upload", "request", "call", "connect")),
)


def risk_by_name(name: Column) -> Column:
    out = F.when(F.lit(False), "")
    for risk, words in RISK_WORDS:
        out = out.when(F.lower(name).rlike("|".join(words)), risk)
    return out.otherwise("read_only")


def risk_by_method(method: Column) -> Column:
    m = F.upper(method)
    return F.when(m.isin("GET", "HEAD", "OPTIONS"), "read_only").when(m == "DELETE", "destructive").otherwise("side_effects")


def operation_name(operation_id: Column, method: Column, path: Column) -> Column:
    """An operation's own id, else its method and path with '/', '{' and '}' made '_'."""
    return F.coalesce(F.nullif(operation_id, F.lit("")), F.concat(F.lower(method), F.regexp_replace(path, r"[/{}]", "_")))


def operation_description(summary: Column, description: Column, method: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(summary, F.lit("")), F.nullif(description, F.lit("")), F.concat_ws(" ", F.upper(method), path))


# ---- vectors and scores ----------------------------------------------------------------------------------------


def quantize(vector: Column, scale: int = 256) -> Column:
    """int8 components: rounded half away from zero, clipped at 127."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") * scale))).cast("tinyint"))


def l2_distance(a: Column, b: Column) -> Column:
    square = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("long") - y.cast("long")) * (x.cast("long") - y.cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.sqrt(square.cast("double"))


def mean_pool(hidden: Column, mask: Column) -> Column:
    """The mean of token vectors (array of arrays) under a mask (array of 0 and 1), brought to length one; zeros stay zeros."""
    kept = F.filter(F.arrays_zip(hidden.alias("v"), mask.alias("m")), lambda x: x["m"] > 0)
    vectors = F.transform(kept, lambda x: x["v"])
    total = F.aggregate(vectors, F.transform(hidden[0], lambda x: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    length = F.sqrt(F.aggregate(total, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(total, lambda x: F.when(length > 0, x / length).otherwise(F.lit(0.0)))


def nearness(distance: Column) -> Column:
    return 1 / (1 + distance)


def length_score(path: Column) -> Column:
    return 1 / (1 + F.char_length(path) / 64)
