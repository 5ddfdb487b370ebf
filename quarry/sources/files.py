"""Files as documents: discovery by one binaryFile scan, decoding, and line blocks of text."""

from __future__ import annotations

import codecs
import csv
import re
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of temporary files; lines of a block; rows that decide a delimiter.
TEMPORARY = r"^(~\$.*|\.~.*|~WRL.*\.tmp|.*\.tmp|.*\.bak)$"
BLOCK_LINES, SNIFF_ROWS = 80, 20
# Folders of tools, and files that hold secrets, by name and by pattern; none of them is ever indexed.
TOOL_FOLDERS = (
    ".git", ".svn", ".hg", ".cursor", ".codex", ".agents", ".claude", ".windsurf", ".continue", ".aider", ".cline", ".roo", ".gemini", ".openai", ".github", ".gitlab", ".vscode", ".idea", ".vs",
    ".devcontainer", ".obsidian", ".aws", ".azure", ".gcloud", ".kube", ".ssh", ".gnupg", ".docker", "node_modules", "dist", "build", "temp", "tmp", "__macosx",
)
SECRET_NAMES = (
    ".env", ".npmrc", ".pypirc", ".netrc", "credentials.json", "credentials.yaml", "credentials.yml", ".credentials.json", "credential.json", "secrets.json", "secrets.yaml", "secrets.yml", ".secrets.json",
    "token.json", "token.yaml", "token.yml", "tokens.json", ".token.json", "application_default_credentials.json", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "authorized_keys",
    "private.key", "private.pem", "server.key", "client.key",
)
SECRET_PATTERNS = (
    ".env.*", "*-credentials.json", "*-secrets.json", "*.token.json", "client_secret*.json", "client-secret*.json", "service-account*.json", "service_account*.json",
    "config.local.*", "config.private.*", "config.secret.*", "settings.local.*", "local.settings.*",
)
CONTROLS = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def glob_pattern(glob: str) -> str:
    """The pattern, for names in lower case, of a shell glob: * and ? stay within a name; [] as in globs."""
    out, text = [], glob.strip().lower()
    for m in re.finditer(r"\[(\^?)([^\]]+)\]|\\(.)|([*?])|(.)", text, re.S):
        if m[2]:
            out.append(f"[{m[1]}{re.sub(r'([\\[&])', r'\\\1', m[2])}]")
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}[m[4]] if m[4] else re.escape(m[3] or m[5]))
    return "".join(out)


def any_pattern(globs: Iterable[str]) -> str:
    return "|".join(glob_pattern(g) for g in globs if g.strip())


def discover(spark: SparkSession, root: str, extensions: list[str], max_bytes: int = 128 << 20, exclude: tuple[str, ...] = (), paths: list[str] | None = None) -> DataFrame:
    """(path, relative_path, extension, modified, length, content) of the files to index below root, by path; of paths alone, if given.

    Left out are temporary files, secrets, folders of tools, other extensions, larger files, and paths with a folder or
    file whose name an exclude glob matches. Filters on length and time reach the scan, and content is read for what is
    left only. A task reads a file once, so that its hash and its text are of the same bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root if paths is None else [literal_path(p) for p in paths]).where(F.col("length") <= max_bytes)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    files = files.withColumn("relative_path", F.substring_index("path", base, -1))
    low = F.lower("relative_path")
    name, folders = F.regexp_extract("relative_path", r"[^/]*$", 0), F.split(low, "/")
    files = files.withColumn("extension", F.lower(F.regexp_extract(name, r"\.[^.]+$", 0)))
    kept = F.col("extension").isin(*[e.lower() for e in extensions]) & ~name.rlike(f"(?i){TEMPORARY}")
    kept = kept & ~F.arrays_overlap(F.slice(folders, F.lit(1), F.size(folders) - 1), F.array(*map(F.lit, TOOL_FOLDERS)))
    kept = kept & ~F.lower(name).isin(*SECRET_NAMES) & ~F.lower(name).rlike(f"^({any_pattern(SECRET_PATTERNS)})$")
    if exclude:
        kept = kept & ~low.rlike(f"(^|/)({any_pattern(exclude)})(/|$)")
    return files.where(kept).select("path", "relative_path", "extension", F.col("modificationTime").alias("modified"), "length", "content")


def literal_path(path: str) -> str:
    """A path without the meaning that its characters have in patterns of paths."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def discover_all(spark: SparkSession, sources: list[dict]) -> tuple[DataFrame | None, list[dict]]:
    """(files of every enabled source with source_id and source_kind, issues): a source that can't be listed is an issue
    and holds up no other. A source has id, kind, root, extensions and perhaps max_bytes, exclude and paths.
    """
    found, issues = [], []
    for s in sources:
        if not s.get("enabled", True):
            continue
        try:
            files = discover(spark, s["root"], s["extensions"], s.get("max_bytes", 128 << 20), tuple(s.get("exclude", ())), s.get("paths"))
            found.append(files.select(F.lit(s["id"]).alias("source_id"), F.lit(s["kind"]).alias("source_kind"), "*"))
        except AnalysisException as e:
            issues.append({"source_id": s["id"], "path": s["root"], "code": "source_unavailable", "message": str(e).split("\n")[0]})
    return (reduce(DataFrame.unionByName, found) if found else None), issues


def inventory(files: DataFrame) -> DataFrame:
    """(source_id, files, bytes, fingerprint) of each source: equal before and after where nothing has changed.

    The fingerprint is a sum of hashes, so that it needs no order and no list of a source's files in one task.
    """
    h = F.xxhash64("relative_path", "length", F.unix_millis("modified"))
    return files.groupBy("source_id").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.hex(F.sum(h.cast("decimal(38,0)")).cast("string")).alias("fingerprint"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(source_id, relative_path, change) of files that were added, changed or removed between two listings."""
    keys = ["source_id", "relative_path"]
    side = lambda df, k: df.select(*keys, F.struct("length", F.unix_millis("modified").alias("ms")).alias(k))
    both = side(before, "old").join(side(after, "new"), keys, "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.withColumn("change", change).where("change IS NOT NULL").select(*keys, "change")


def decode_named(data: bytes) -> tuple[str, str]:
    """(text, encoding) by byte order mark, else UTF-8, else GB18030, else UTF-8 with replacements; control characters go."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(mark):
            return CONTROLS.sub("", data[len(mark) :].decode(name, "replace")), name
    for name in ("utf-8", "gb18030"):
        try:
            return CONTROLS.sub("", data.decode(name)), name
        except UnicodeDecodeError:
            continue
    return CONTROLS.sub("", data.decode("utf-8", "replace")), "utf-8 with replacements"


def decode(data: bytes) -> str:
    return decode_named(data)[0]


def line_blocks(text: str, most: int = BLOCK_LINES) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of runs of lines between blank ones, of at most that many lines; lines count from 1."""
    out: list[tuple[int, int, str]] = []
    run: list[str] = []
    for n, line in enumerate([*re.split(r"\r\n|\r|\n", text), ""], 1):
        if line.strip():
            run.append(line.rstrip())
        if run and (not line.strip() or len(run) >= most):
            last = n if line.strip() else n - 1
            out.append((last - len(run) + 1, last, "\n".join(run)))
            run = []
    return out


def delimiter(text: str, rows: int = SNIFF_ROWS) -> str:
    """The separator under which most of the first rows have equally many fields, then the one that gives most fields."""

    def score(d: str) -> int:
        sizes = [len(r) for _, r in zip(range(rows), csv.reader(text.splitlines(), delimiter=d), strict=False) if r]
        usual = max(set(sizes), key=sizes.count) if sizes else 0
        return (sizes.count(usual) * 1000 + usual) if usual > 1 else 0

    return max(",\t;", key=score)


def blocks(files: DataFrame) -> DataFrame:
    """(path, ordinal, first_line, last_line, text) of the text files of discover()."""

    def parse(s: pd.Series) -> pd.Series:
        return s.map(lambda b: [{"first_line": a, "last_line": z, "text": t} for a, z, t in line_blocks(decode(bytes(b)))])

    found = F.pandas_udf(parse, "array<struct<first_line:long,last_line:long,text:string>>")(F.col("content"))
    return files.select("path", F.posexplode(found).alias("ordinal", "b")).select("path", "ordinal", "b.*")
