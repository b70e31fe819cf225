"""File names and file kinds as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signatures: kind, leading bytes (hex), and where they are not at 0 their place; or a second signature and its place.
#: The first that fits counts. Fixed values.
MAGIC = (
    ("image/png", "89504E470D0A1A0A"), ("image/jpeg", "FFD8FF"), ("image/webp", "52494646", 0, "57454250", 8), ("image/gif", "47494638"),
    ("image/tiff", "49492A00"), ("image/tiff", "4D4D002A"), ("image/bmp", "424D"), ("image/x-icon", "00000100"), ("image/vnd.adobe.photoshop", "38425053"),
    ("image/heic", "66747970", 4, "68656963", 8),
    ("application/pdf", "25504446"), ("application/rtf", "7B5C727466"),
    ("application/zip", "504B0304"), ("application/gzip", "1F8B"), ("application/x-bzip2", "425A68"), ("application/x-xz", "FD377A585A00"),
    ("application/x-7z-compressed", "377ABCAF271C"), ("application/vnd.rar", "526172211A0700"), ("application/vnd.rar", "526172211A070100"),
    ("application/x-lzip", "4C5A4950"), ("application/zstd", "28B52FFD"), ("application/vnd.ms-cab-compressed", "4D534346"),
    ("audio/wav", "52494646", 0, "57415645", 8), ("audio/aiff", "464F524D", 0, "41494646", 8), ("audio/flac", "664C6143"), ("application/ogg", "4F676753"),
    ("audio/midi", "4D546864"), ("audio/mpeg", "494433"),
    ("video/x-msvideo", "52494646", 0, "41564920", 8), ("video/x-ms-wmv", "3026B2758E66CF11"), ("video/x-matroska", "1A45DFA3"), ("video/x-flv", "464C56"),
    ("video/quicktime", "66747970", 4, "71742020", 8), ("video/mp4", "66747970", 4),
    ("application/vnd.sqlite3", "53514C6974652033"), ("application/wasm", "0061736D"), ("application/x-elf", "7F454C46"),
    ("application/vnd.microsoft.portable-executable", "4D5A"), ("application/x-mach-binary", "CFFAEDFE"), ("application/x-mach-binary", "CEFAEDFE"),
    ("application/x-mach-binary", "FEEDFACF"), ("application/x-mach-binary", "FEEDFACE"), ("application/java-vm", "CAFEBABE"),
    ("application/vnd.android.dex", "6465780A"), ("application/vnd.debian.binary-package", "213C617263683E"), ("application/x-rpm", "EDABEEDB"),
    ("application/vnd.tcpdump.pcap", "D4C3B2A1"), ("application/vnd.tcpdump.pcap", "A1B2C3D4"), ("application/x-pcapng", "0A0D0D0A"),
    ("application/x-shockwave-flash", "465753"), ("application/x-shockwave-flash", "435753"), ("application/x-shockwave-flash", "5A5753"),
    ("application/vnd.apache.parquet", "50415231"), ("application/avro", "4F626A01"), ("application/x-nintendo-nes-rom", "4E45531A"),
)
UNKNOWN = "application/octet-stream"
#: Kinds whose content does not shrink further; fixed values.
PRE_COMPRESSED = (
    "image/png", "image/jpeg", "image/webp", "image/gif", "image/heic", "application/zip", "application/gzip", "application/x-bzip2", "application/x-xz",
    "application/x-7z-compressed", "application/vnd.rar", "application/x-lzip", "application/zstd", "application/vnd.ms-cab-compressed", "audio/mpeg",
    "video/quicktime", "video/mp4", "video/x-msvideo", "video/x-ms-wmv", "video/x-matroska", "video/x-flv",
)
#: Names Windows keeps to itself; fixed values.
RESERVED = "(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])([.]|$)"
#: Marks that turn the direction of text.
BIDI = r"[\u202A-\u202E\u2066-\u2069]"
PROFILES = ("all", "posix", "windows", "macos-smb", "zip", "url-path", "s3-key", "opaque")


def mime_type(content: Column) -> Column:
    """Kind by the first 16 bytes; application/octet-stream if unknown, null of null.

    One flat CASE whose conditions all read the head: Spark then computes content and head once a row, where nested
    ones compute them anew for each signature.
    """
    head = F.hex(F.substring(content, 1, 16))
    at = lambda place, sign: F.substring(head, 2 * place + 1, len(sign)) == sign if place else F.startswith(head, F.lit(sign))
    found = F.when(head.isNull(), F.lit(None).cast("string"))
    for kind, sign, *more in MAGIC:
        place, second, second_place = [*more, *(0, "", 0)[len(more) :]]
        found = found.when(at(place, sign) & at(second_place, second) if second else at(place, sign), kind)
    frame = head.rlike("^FF[EF][0-9A-F]") & (F.conv(F.substring(head, 4, 1), 16, 10).cast("int") != 1)
    return found.when(frame, "audio/mpeg").otherwise(UNKNOWN)


def pre_compressed(mime: Column) -> Column:
    return F.coalesce(mime.isin(*PRE_COMPRESSED), F.lit(False))


def _percent(name: Column) -> Column:
    """All bytes but RFC 3986's unreserved ones as %XX."""
    each = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.when(c.rlike(r"^[A-Za-z0-9\-._~]$"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")))
    return F.array_join(each, "")


def _capped(name: Column, most: int) -> Column:
    """As many whole characters as fit into so many bytes of UTF-8."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("bytes"))
    step = lambda s, c: F.struct(F.when(s["bytes"] + F.octet_length(c) <= most, F.concat(s["text"], c)).otherwise(s["text"]).alias("text"), (s["bytes"] + F.octet_length(c)).alias("bytes"))
    return F.when(F.octet_length(name) <= most, name).otherwise(F.aggregate(F.split(name, ""), start, step, lambda s: s["text"]))


def safe_filename(name: Column, profile: str = "all", most: int | None = None, opaque_id: Column | None = None) -> Column:
    """A name that a destination takes, by profile; never empty, never a dot segment (those become _).

    all drops control characters; the others replace reserved characters by _. url-path and s3-key percent-encode, opaque
    is the id with the name's own extension if that is plain. Names are taken as normalised already (Spark has no NFC).
    """
    if profile not in PROFILES:
        raise ValueError(f"no profile {profile!r}")
    if profile == "opaque":
        extension = F.regexp_extract(name, r"^.+[.]([A-Za-z0-9]{1,16})$", 1)
        return F.when(extension != "", F.concat(opaque_id, F.lit("."), F.lower(extension))).otherwise(opaque_id)
    most = most or {"macos-smb": 240, "url-path": 1024, "s3-key": 1024}.get(profile, 255)
    out = F.regexp_replace(name, BIDI, "")
    if profile == "all":
        out = F.regexp_replace(out, r"[\x00-\x1f\x7f]", "")
    else:
        out = F.regexp_replace(out, r"^[\s\x00-\x1f\x7f]+|[\s\x00-\x1f\x7f]+$", "")
    if profile in ("url-path", "s3-key"):
        out = F.regexp_replace(out, "^/+", "") if profile == "s3-key" else out
        return F.when(out == "", "_").otherwise(_percent(_capped(out, most)))
    if profile == "zip":
        out = F.regexp_replace(F.regexp_replace(out, r"\\\\", "/"), "^/+", "")
    elif profile == "posix":
        out = F.regexp_replace(out, "/", "_")
    else:
        out = F.regexp_replace(out, r'[<>:"/\\|?*]', "_")
        out = F.regexp_replace(F.regexp_replace(out, r"[\x00-\x1f\x7f]", "_"), r"[. ]+$", "")
        out = F.when(out.rlike(RESERVED), F.concat(F.lit("_"), out)).otherwise(out)
        if profile == "macos-smb":
            out = F.when(out.rlike(r"(?i)^([.]DS_Store|[.]localized|[.]fseventsd|[.]_.+)$"), F.concat(F.lit("_"), out)).otherwise(out)
    out = F.when((out == "") | out.rlike(r"(^|[/\\])[.]{2}([/\\]|$)") | (out == "."), "_").otherwise(out)
    return _capped(out, most)


#: Digits of ULIDs (no I, L, O, U) beside those of base 32; fixed values.
ULID_DIGITS, BASE_32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def ulid(millis: Column, entropy: Column) -> Column:
    """26 characters that sort by time: ten for the milliseconds, sixteen for the first 80 bits of entropy (hex text)."""
    part = lambda c, n: F.lpad(F.conv(c, 16, 32), n, "0")
    digits = F.concat(part(F.hex(millis), 10), part(F.substring(entropy, 1, 10), 8), part(F.substring(entropy, 11, 10), 8))
    return F.translate(digits, BASE_32, ULID_DIGITS)
