"""Text as column expressions: words, lines, trimming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and digits of any script; everything else, the underscore too, separates words.
WORD = r"[\p{L}\p{N}]+"


def words(text: Column | str) -> Column:
    """The words of the lower-cased text in order; null and empty texts have none."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(WORD), F.lit(0))


def strip_space(text: Column | str) -> Column:
    """Cut surrounding white space of any script; null stays null."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(col, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def lines(text: Column | str) -> Column:
    """The lines of a text; they end in CR LF, CR or LF. Null is like an empty text."""
    col = F.col(text) if isinstance(text, str) else text
    return F.split(F.coalesce(col, F.lit("")), r"\r\n|\r|\n")


def shingles(items: Column, size: int) -> Column:
    """64-bit hashes of each run of ``size`` consecutive items, repeats removed, in ascending order.

    Fewer than ``size`` items give an empty array.
    """
    n = F.size(items) - (size - 1)
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.xxhash64(*[F.try_element_at(items, i + k) for k in range(size)]),
    )
    return F.when(n >= 1, F.array_sort(F.array_distinct(runs))).otherwise(F.array().cast("array<bigint>"))


#: White space of any script, as a pattern for split and replace.
SPACE = r"(?U)\s+"

#: Words that the full-text index leaves out, in natural order.
INDEX_STOPWORDS = (
    "the", "and", "for", "are", "was", "with", "this", "that", "from", "have", "not", "but", "they", "their", "been",
    "more", "also", "its", "can", "will", "one", "all", "any", "has", "had", "his", "her", "our", "your", "when",
)

#: Names that a path segment must not have.
DEVICE_NAMES = (
    "con", "prn", "aux", "nul", "com1", "com2", "com3", "com4", "com5", "com6", "com7", "com8", "com9",
    "lpt1", "lpt2", "lpt3", "lpt4", "lpt5", "lpt6", "lpt7", "lpt8", "lpt9",
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def index_tokens(text: Column | str) -> Column:
    """Tokens of the full-text index in order.

    Split at white space, keep letters and digits, lower ASCII letters only, drop tokens of up to two bytes and the
    index's stop words. Null has none.
    """
    raw = F.split(F.coalesce(_col(text), F.lit("")), SPACE)
    tidy = F.transform(raw, lambda w: F.translate(F.regexp_replace(w, r"[^\p{IsAlphabetic}\p{N}]", ""), _UPPER, _LOWER))
    return F.filter(tidy, lambda w: (F.octet_length(w) > 2) & ~w.isin(*INDEX_STOPWORDS))


def normal_words(text: Column | str) -> Column:
    """White-space separated words in lower case; punctuation stays."""
    return F.filter(F.split(F.lower(F.coalesce(_col(text), F.lit(""))), SPACE), lambda w: w != "")


def content_hash(text: Column | str) -> Column:
    """SHA-256 of the normalised words; texts that differ in white space and case only agree."""
    return F.sha2(F.array_join(normal_words(text), " "), 256)


def fingerprint_tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(_col(text), F.lit(""))), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")


def shingle_hash(text: Column) -> Column:
    """The first 64 bits of SHA-256 as 16 hexadecimal digits, which sort like the unsigned number."""
    return F.substring(F.sha2(text, 256), 1, 16)


def joined_shingles(tokens: Column, size: int = 3, short: bool = True) -> Column:
    """Sorted distinct hashes of each run of ``size`` tokens joined by spaces.

    Fewer tokens give one hash of all of them if ``short``, else none.
    """
    n = F.size(tokens)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, size), " "))
    hashes = F.array_sort(F.array_distinct(F.transform(runs, shingle_hash)))
    few = F.array(shingle_hash(F.array_join(tokens, " "))) if short else F.array().cast("array<string>")
    return F.when(n >= size, hashes).otherwise(few)


def slug(title: Column | str) -> Column:
    """An id made of a title: lower-case words joined by dashes; a reserved device name gets an underscore."""
    parts = F.filter(F.split(F.lower(_col(title)), r"[^\p{IsAlphabetic}\p{N}]"), lambda s: s != "")
    plain = F.array_join(parts, "-")
    return F.when(plain.isin(*DEVICE_NAMES), F.concat(plain, F.lit("_"))).otherwise(plain)


def is_safe_path(path: Column | str) -> Column:
    """Whether an id may be a relative path: no root, no ``\\`` or ``:``, no empty, dotted, spaced or device segment."""
    p = _col(path)
    stem = lambda s: F.lower(F.substring_index(s, ".", 1))
    good = lambda s: (s != "") & ~s.rlike(r"[. ]$") & ~stem(s).isin(*DEVICE_NAMES)
    return ~p.startswith("/") & ~p.rlike(r"[\\:]") & F.forall(F.split(p, "/"), good)


def cut_bytes(text: Column, limit: int) -> Column:
    """The text's first ``limit`` bytes of UTF-8, without a character cut in two."""
    whole = F.octet_length(text) <= limit
    head = F.substring(F.encode(text, "UTF-8"), 1, limit)
    # an incomplete last character is one lead byte of 2 to 4 with too few followers
    partial = F.regexp_extract(F.hex(F.substring(head, F.greatest(F.lit(1), F.octet_length(head) - 2), 3)), r"^(?:..)*?([CDEF].(?:[89AB].)*)$", 1)
    have = (F.length(partial) / 2).cast("int")
    need = (
        F.when(partial.rlike("^F"), 4).when(partial.rlike("^E"), 3).when(partial.rlike("^[CD]"), 2).otherwise(0)
    )
    kept = F.when(have < need, F.octet_length(head) - have).otherwise(F.octet_length(head))
    return F.when(whole, text).otherwise(F.decode(F.substring(head, F.lit(1), kept), "UTF-8"))


def snippet(description: Column | str, content: Column | str, limit: int = 360) -> Column:
    """The description if it isn't blank, else the content, with single spaces, cut to ``limit`` bytes."""
    d = _col(description)
    source = F.when(F.coalesce(d, F.lit("")).rlike(r"(?U)\S"), d).otherwise(F.coalesce(_col(content), F.lit("")))
    return cut_bytes(F.array_join(F.filter(F.split(source, SPACE), lambda w: w != ""), " "), limit)


def first_line_title(text: Column | str, limit: int = 80, empty: str = "Promoted lesson") -> Column:
    """The first line without surrounding white space, with an ellipsis where it is longer than ``limit`` characters."""
    line = strip_space(F.element_at(lines(text), 1))
    head = F.substring(line, 1, limit)
    return F.when(line == "", F.lit(empty)).when(F.char_length(line) > limit, F.concat(head, F.lit("…"))).otherwise(head)


def hashtags(text: Column | str) -> Column:
    """Sorted distinct ``#tags`` in lower case: words of ASCII letters, digits, colons and dashes behind a ``#``."""
    marked = F.filter(F.split(F.coalesce(_col(text), F.lit("")), SPACE), lambda w: w.startswith("#"))
    tidy = F.transform(marked, lambda w: F.regexp_replace(F.substring(w, F.lit(2), F.length(w)), r"[^\p{IsAlphabetic}\p{N}:]+$", ""))
    return F.array_sort(F.array_distinct(F.transform(F.filter(tidy, lambda t: t.rlike("^[A-Za-z0-9:-]+$")), F.lower)))


#: What marks a line as a lesson.
LESSON_PREFIXES = ("lesson:", "gotcha:", "pattern:", "learned:")


def lessons(text: Column | str, limit: int | None = 2000) -> Column:
    """The lessons of a message: what follows a lesson prefix on its line, else the whole message if it isn't blank.

    Each is cut to ``limit`` characters; None cuts nothing.
    """
    kept = lambda x: x if limit is None else F.substring(x, 1, limit)
    pattern = r"(?i)^(?:" + "|".join(LESSON_PREFIXES) + ")"
    bare = F.transform(lines(text), lambda x: strip_space(F.regexp_replace(strip_space(x), r"^[-* ]+", "")))
    marked = F.transform(F.filter(bare, lambda x: x.rlike(pattern)), lambda x: strip_space(F.regexp_replace(x, pattern, "")))
    found = F.transform(F.filter(marked, lambda x: x != ""), kept)
    whole = strip_space(F.coalesce(_col(text), F.lit("")))
    rest = F.when(whole == "", F.array().cast("array<string>")).otherwise(F.array(kept(whole)))
    return F.when(F.size(found) > 0, found).otherwise(rest)


#: How a prompt begins, or what it holds, that corrects what was done before.
CORRECTION_PREFIXES = ("no,", "no.", "no ", "nope", "stop", "wait,")
CORRECTION_PHRASES = (
    "don't", "do not", "dont ", "that's not", "thats not", "not what i", "wrong", "incorrect", "instead", "you missed",
    "you forgot", "should have", "shouldn't", "should not", "revert", "undo", "redo", "try again", "rather than",
)


def is_correction(prompt: Column | str) -> Column:
    """Whether a prompt rejects or redirects earlier work; null isn't one."""
    lower = F.lower(strip_space(F.coalesce(_col(prompt), F.lit(""))))
    begins = "|".join(p.replace(".", r"\.") for p in CORRECTION_PREFIXES)
    return lower.rlike(f"^(?:{begins})|" + "|".join(CORRECTION_PHRASES))


def is_documentation_path(path: Column | str) -> Column:
    """Whether a path lies in a folder of documents or reports, or is a Markdown file."""
    return F.concat(F.lit("/"), _col(path)).rlike(r"/docs/|/reports/|\.md$")


#: Command-line tools, and first path segments of a repository. A house's own are added by parameter.
KNOWN_TOOLS = (
    "apt", "brew", "bun", "bunx", "cargo", "claude", "cmake", "codex", "curl", "deno", "docker", "gh", "git", "go",
    "gradle", "helm", "jq", "kubectl", "launchctl", "make", "mvn", "node", "npm", "npx", "pip", "pip3", "pnpm",
    "python", "python3", "rustc", "rustup", "sqlite3", "systemctl", "terraform", "uv", "uvx", "yarn",
)
REPOSITORY_FOLDERS = (
    ".claude", ".github", "crates", "docs", "hooks", "lib", "scripts", "shared", "skills", "src", "tests",
)


def names_tool(text: Column | str, tools: tuple[str, ...] = KNOWN_TOOLS) -> Column:
    """Whether a code span begins with a known tool, or anything names a version (``name@1.2``, ``name = "1.2"``)."""
    pieces = F.split(F.coalesce(_col(text), F.lit("")), "`")
    spans = F.transform(F.filter(pieces, lambda _, i: i % 2 == 1), strip_space)
    first = lambda s: F.element_at(F.split(s, SPACE), 1)
    span = lambda s: (
        F.lower(first(s)).isin(*tools) | _is_versioned(first(s))
        | s.rlike(r'(?U)^[A-Za-z0-9_-]+\s*=\s*"*[\^~=<>]*[0-9]')
    )
    plain = F.transform(F.split(F.coalesce(_col(text), F.lit("")), SPACE), lambda w: F.regexp_replace(w, r"""^[`'"(),;]+|[`'"(),;]+$""", ""))
    return F.exists(spans, span) | F.exists(plain, _is_versioned)


def _is_versioned(word: Column) -> Column:
    name = F.regexp_replace(F.regexp_extract(word, "^(.*)@", 1), "^@+", "")
    return word.contains("@") & name.rlike("^[A-Za-z0-9._/-]+$") & F.regexp_extract(word, "([^@]*)$", 1).rlike(r"^[\^~=v]*[0-9]")


def has_repository_path(text: Column | str, folders: tuple[str, ...] = REPOSITORY_FOLDERS) -> Column:
    """Whether a word is a path within a repository: relative, in a known folder, or ending in a file name."""

    def path(word: Column) -> Column:
        bare = F.regexp_replace(word, r"""^[`'"()\[\]{},;]+|[`'"()\[\]{},;]+$""", "")
        bare = F.regexp_replace(F.substring_index(bare, ":", 1), r"\.+$", "")
        parts = F.filter(F.split(bare, "/"), lambda s: s != "")
        inside = (F.size(parts) >= 2) & (
            F.try_element_at(parts, F.lit(1)).isin(*folders) | F.try_element_at(parts, F.lit(-1)).rlike(r".\.[^.]+$")
        )
        return bare.contains("/") & ~bare.contains("://") & ~bare.rlike(r"^[/~$@]") & (bare.rlike(r"^\.\.?/") | inside)

    return F.exists(F.split(F.coalesce(_col(text), F.lit("")), SPACE), path)


def body_links(content: Column | str) -> Column:
    """Ids of pages that a Markdown body links to, in order, each once.

    Inline links to ``/path.md`` count; fenced and inline code, images, anchors and other targets do not. Links written
    by reference are not resolved.
    """
    text = F.regexp_replace(F.coalesce(_col(content), F.lit("")), r"(?ms)^ {0,3}(```|~~~).*?(?:^ {0,3}\1[`~]*[ \t]*$|\z)", "")
    text = F.regexp_replace(text, r"(`+)(?!`).*?(?<!`)\1(?!`)", "")
    found = F.regexp_extract_all(text, F.lit(r"(?<!!)\[(?:[^\[\]]|\[[^\[\]]*\])*\]\(\s*<?/+([^\s()<>]+)\.md>?(?:\s+[\"'(][^\n]*?[\"')])?\s*\)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def bounded(text: Column | str, limit: int = 500) -> Column:
    """The first ``limit`` characters, as errors and details are kept."""
    return F.substring(_col(text), 1, limit)


def _lists(items: Column) -> Column:
    return F.coalesce(items, F.array().cast("array<string>"))


def overlap_ratio(a: Column, b: Column, both_empty: float) -> Column:
    """Jaccard similarity of two word lists as sets; two empty ones have the given value."""
    common, either = F.size(F.array_intersect(_lists(a), _lists(b))), F.size(F.array_union(_lists(a), _lists(b)))
    return F.when(either == 0, F.lit(both_empty)).otherwise(common / either)
