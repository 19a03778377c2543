"""Scalars of media enrichment: colours, keys, durations, frame rates, tempo factors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Majors along the circle of fifths, each followed by its relative minor; a key's number is its place.
CIRCLE = ("C", "Am", "G", "Em", "D", "Bm", "A", "F#m", "E", "C#m", "B", "G#m", "F#", "Ebm", "Db", "Bbm", "Ab", "Fm", "Eb", "Cm", "Bb", "Gm", "F", "Dm")
#: Extensions of each kind.
AUDIO = (".wav", ".mp3", ".m4a", ".aif", ".aiff", ".flac", ".ogg")
IMAGE = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".tif", ".tiff", ".bmp")
DOCUMENT = (".pdf", ".txt", ".docx", ".doc", ".md", ".rtf")
VIDEO = (".mp4", ".mov", ".avi", ".mkv")
DESIGN = (".psd", ".ai", ".indd", ".sketch", ".fig", ".xd")
CODE = (".js", ".py", ".rs", ".html", ".css", ".json", ".yaml", ".toml")
WORKING = (".asd", ".als", ".logicx", ".ptx")
TEXT = (".pdf", ".txt", ".docx", ".doc", ".md", ".rtf", ".epub")
FONT = (".otf", ".ttf", ".woff", ".woff2", ".vfb")
KINDS = {"audio": AUDIO, "image": IMAGE, "document": DOCUMENT, "video": VIDEO, "design": DESIGN, "code": CODE, "working": WORKING}


def media_type(extension: Column) -> Column:
    """audio, image, text, video, font or other."""
    e = F.lower(extension)
    kinds = {"image": IMAGE, "text": TEXT, "video": (*VIDEO, ".webm"), "font": FONT}
    out = F.when(e.isin(*AUDIO), "audio")
    for kind, known in kinds.items():
        out = out.when(e.isin(*known), kind)
    return out.otherwise("other")


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def color_temperature(r: Column, g: Column, b: Column) -> Column:
    total = r + g + b
    return F.when(total < 1, 0.0).otherwise((r - b) / F.greatest(total, F.lit(1.0)))


def hsl(r: Column, g: Column, b: Column) -> Column:
    """struct<h (degrees), s, l> of 0..255 channels."""
    r, g, b = r / 255.0, g / 255.0, b / 255.0
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d, light = top - low, (top + low) / 2
    safe = F.when(d == 0, 1.0).otherwise(d)
    turn = F.when(top == r, (g - b) / safe + F.when(g < b, 6).otherwise(0)).when(top == g, (b - r) / safe + 2).otherwise((r - g) / safe + 4)
    gray = d < 1e-10
    spread = F.when(light > 0.5, 2 - top - low).otherwise(top + low)
    return F.struct(F.when(gray, 0.0).otherwise(turn * 60).alias("h"), F.when(gray, 0.0).otherwise(d / F.when(spread == 0, 1.0).otherwise(spread)).alias("s"), light.alias("l"))


def quantised(channel: Column, bits: int) -> Column:
    """The top bits of a byte."""
    return channel.cast("int").bitwiseAND(F.lit((0xFF << (8 - bits)) & 0xFF))


def circle_position(key: Column) -> Column:
    """Number of a key on the circle, also where major and minor are spelled out; null for other names."""
    s = F.trim(key)
    for word, short in ((" minor", "m"), (" major", ""), (" min", "m"), (" maj", "")):
        s = F.replace(s, F.lit(word), F.lit(short))
    at = F.array_position(F.array(*[F.lit(k) for k in CIRCLE]), F.trim(s))
    return F.when(at > 0, (at - 1).cast("double"))


def circle_distance(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, 24 - d)


def frame_rate(text: Column) -> Column:
    """`a/b` or a plain number; null for other texts and a zero divisor."""
    a = F.split_part(text, F.lit("/"), F.lit(1)).try_cast("double")
    b = F.split_part(text, F.lit("/"), F.lit(2)).try_cast("double")
    return F.when(F.contains(text, F.lit("/")), F.when(b > 0, F.try_divide(a, b))).otherwise(text.try_cast("double"))


def safe_name(name: Column) -> Column:
    """Letters, digits and -_. stay; all else becomes _."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_")


def tempo_factors(ratio: Column) -> Column:
    """A ratio as factors within 0.5 and 2, whole factors first."""
    n = F.when(ratio > 2, F.ceil(F.log2(ratio)) - 1).when(ratio < 0.5, F.ceil(-F.log2(ratio)) - 1).otherwise(0).cast("int")
    step = F.when(ratio > 2, 2.0).otherwise(0.5)
    return F.concat(F.array_repeat(step, n), F.array(ratio / F.pow(step, n)))


def human_size(size: Column) -> Column:
    """Bytes, KB and MB with one decimal, GB with two."""
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1 << 20, F.format_string("%.1f KB", size / 1024.0))
        .when(size < 1 << 30, F.format_string("%.1f MB", size / float(1 << 20)))
        .otherwise(F.format_string("%.2f GB", size / float(1 << 30)))
    )


def grid_cell(position: Column, columns: int, cell: int = 300, gap: int = 4) -> Column:
    """struct<col, row, x, y> of a 0-based position in a moodboard."""
    col, row = position % columns, F.floor(position / columns)
    return F.struct(col.cast("bigint").alias("col"), row.cast("bigint").alias("row"), (col * (cell + gap)).cast("bigint").alias("x"), (row * (cell + gap)).cast("bigint").alias("y"))
