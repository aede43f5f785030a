"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the term-vector tokenizer, by language.
STOPWORDS_EN = (
    "a an the and or but in on at to for of with by from up about into through during is are was were be been being have has had do does did will "
    "would could should may might shall can need dare ought used i me my myself we our ours ourselves you your yours yourself yourselves he him his "
    "himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am if then else when where "
    "why how all both each few more most other some such no not only same so than too very just because as until while although though after before "
    "since between out off over under again further once here there any also"
).split()
STOPWORDS_ID = (
    "yang dan di ke dari ini itu dengan untuk pada adalah dalam tidak akan juga ada saya kita kami mereka dia ia anda kamu aku bisa dapat harus sudah "
    "telah sedang masih lebih sangat paling hanya jika kalau karena sehingga namun tetapi tapi atau maupun bahwa oleh seperti antara setelah sebelum "
    "ketika saat semua setiap beberapa banyak sedikit lain lainnya tersebut nya pun lah kah dah agar supaya maka meski walaupun meskipun selain selama "
    "sejak hingga sampai tentang terhadap melalui tanpa bagi atas bawah depan belakang kiri kanan sini sana situ begitu begini demikian hal cara waktu tempat"
).split()
STOPWORDS = (*STOPWORDS_EN, *STOPWORDS_ID)

# Letters that full-text tokens fold, and what they fold to.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyy"

# File extension to language.
LANGUAGES = {
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "typescriptreact", "js": "javascript", "mjs": "javascript", "cjs": "javascript",
    "jsx": "javascriptreact", "vue": "vue", "svelte": "svelte", "astro": "astro", "md": "markdown", "mdx": "markdown", "py": "python", "php": "php",
    "go": "go", "rs": "rust", "java": "java", "rb": "ruby", "kt": "kotlin", "kts": "kotlin", "swift": "swift", "dart": "dart", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "html": "html", "htm": "html", "xhtml": "html", "css": "css",
    "scss": "scss", "sass": "sass", "less": "less", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "ini": "ini", "cfg": "ini",
    "conf": "ini", "env": "env", "xml": "xml", "svg": "xml", "sh": "shellscript", "bash": "shellscript", "zsh": "shellscript", "fish": "shellscript",
    "ps1": "powershell", "bat": "batch", "cmd": "batch", "scala": "scala", "cs": "csharp", "fs": "fsharp", "zig": "zig", "erl": "erlang", "ex": "elixir",
    "exs": "elixir", "clj": "clojure", "lua": "lua", "pl": "perl", "pm": "perl", "t": "perl", "r": "r", "jl": "julia", "m": "objectivec",
    "mm": "objectivecpp", "ejs": "ejs", "hbs": "handlebars", "mustache": "mustache", "njk": "nunjucks", "pug": "pug", "haml": "haml", "liquid": "liquid",
    "twig": "twig", "razor": "razor", "latte": "latte", "smarty": "smarty", "tpl": "smarty", "webc": "webc", "wxp": "wxp", "wxt": "wxt",
    "graphql": "graphql", "gql": "graphql", "proto": "protobuf", "thrift": "thrift", "sql": "sql", "plist": "plist", "xib": "xib",
    "storyboard": "storyboard", "pbxproj": "pbxproj", "xcconfig": "xcconfig", "entitlements": "entitlements", "gradle": "gradle", "tex": "latex",
    "bib": "bibtex", "rst": "restructuredtext", "asciidoc": "asciidoc", "adoc": "asciidoc", "dockerfile": "dockerfile", "lock": "lockfile",
}
BARE_NAMES = {"dockerfile": "dockerfile", "makefile": "makefile", "justfile": "justfile", "containerfile": "dockerfile"}


def strings(values) -> Column:
    """A literal array of strings, typed even when empty."""
    return F.array(*map(F.lit, values)).cast("array<string>")


def normalized(text: Column) -> Column:
    """Lower case; only a-z, 0-9, white space, underscore, hyphen and dot stay; single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s_\-.]", " "), r"\s+", " "))


def tokens(text: Column, stopwords=STOPWORDS) -> Column:
    """Tokens of the term vectors; literals in ``isin`` are looked up by hash, not one by one."""
    return F.filter(F.split(normalized(text), " "), lambda t: (t != "") & ~t.isin(*stopwords))


def stub_tokens(text: Column, stopwords=STOPWORDS) -> Column:
    """Tokens of the lightweight vectors: word characters and Latin letters with accents, three or more, no stop word."""
    stop = strings(stopwords)
    parts = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\w\s\u00C0-\u017F]", " ")), r"\s+")
    return F.filter(parts, lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t))


def word_tokens(text: Column, least: int = 2) -> Column:
    """Runs of a-z and 0-9 of at least ``least`` characters."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: F.length(t) >= least)


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def fts_tokens(text: Column) -> Column:
    """Tokens of the full-text index: lower case, accents folded, split at whatever is no letter or digit."""
    return F.filter(F.split(folded(text), "[^a-z0-9]+"), lambda t: t != "")


def issue_refs(text: Column) -> Column:
    """Numbers behind a hash sign, ascending, once each."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"#(\d+)"), F.lit(1)), lambda x: x.cast("long"))))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def snippet(line: Column, start: Column, length: Column | int, around: int = 40) -> Column:
    """The match at ``start`` (from 0) with its surroundings; an ellipsis where the line goes on."""
    low = F.greatest(F.lit(0), start - around)
    high = F.least(F.length(line), start + length + around)
    left, right = F.when(low > 0, "…").otherwise(""), F.when(high < F.length(line), "…").otherwise("")
    return F.concat(left, F.substring(line, low + 1, high - low), right)


def doc_summary(text: Column, most: int = 140) -> Column:
    """White space collapsed if that is short enough, else the first line, else a cut with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    first = F.trim(F.element_at(F.split(F.trim(text), r"\r?\n"), 1))
    cut = F.concat(F.rtrim(F.substring(first, 1, most - 1)), F.lit("…"))
    return F.when(F.length(flat) <= most, flat).when(F.length(first) <= most, first).otherwise(cut)


def line_count(text: Column) -> Column:
    """0 of an empty text, else newlines and one."""
    return F.when(F.length(text) == 0, 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)


def language_of(path: Column) -> Column:
    """Language of a file by its extension, or its name if it has none; null if unknown."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    extension = F.regexp_extract(name, r"[^.]\.([^.]+)$", 1)
    by_name = F.try_element_at(table(BARE_NAMES), name)
    return F.when(extension != "", F.try_element_at(table(LANGUAGES), extension)).when(~name.contains("."), by_name)


def repo_name(repo: Column) -> Column:
    """Last segment of a path-like repository name; the repo member of a JSON form."""
    form = F.when(repo.startswith("{") & repo.endswith("}"), F.nullif(F.get_json_object(repo, "$.repo"), F.lit("")))
    return F.trim(F.coalesce(form, F.element_at(F.split(repo, "/"), -1)))


def repo_owner(repo: Column) -> Column:
    parts = F.split(repo, "/", 2)
    return F.when(F.size(parts) > 1, F.trim(F.element_at(parts, 1))).otherwise("")


def name_variants(name: Column) -> Column:
    """The name, with hyphens as dots, as camel case, dots as hyphens, underscores as hyphens; once each."""
    words = F.split(name, "-")
    camel = F.concat(F.element_at(words, 1), F.array_join(F.transform(F.slice(words, F.lit(2), F.size(words)), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))), ""))
    return F.array_distinct(F.array(name, F.translate(name, "-", "."), camel, F.translate(name, ".", "-"), F.translate(name, "_", "-")))


def completion_score(value: Column, typed: str) -> Column:
    """100 if equal, 75 as a prefix, 50 inside, 25 inside without separators, else 0; case-insensitive."""
    low, q = F.lower(value), typed.lower()
    bare = lambda c: F.regexp_replace(c, r"[\s_\-./]+", "")
    return F.when(low == q, 100).when(low.startswith(q), 75).when(low.contains(q), 50).when(bare(low).contains(bare(F.lit(q))) & (bare(F.lit(q)) != ""), 25).otherwise(0)


def content_hash(*columns: str) -> Column:
    """SHA-256 of the columns as one JSON object."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def valid_entity_name(name: Column, stopwords=STOPWORDS) -> Column:
    """At least three characters, with a letter, no stop word, no bare number or run of symbols."""
    low = F.lower(F.trim(name))
    return (F.length(low) >= 3) & low.rlike("[a-z]") & ~F.array_contains(strings(stopwords), low) & ~low.rlike(r"^[\W_\d]+$")


def metadata_title(title: Column) -> Column:
    """The title starts with brackets that hold an agent, role, model, date or source."""
    return F.trim(title).rlike(r"(?i)^\[[^\]]{0,200}(?:agent:|role:|model:|\d{4}-\d{2}-\d{2}|source_)[^\]]*\]")


def camel_parts(text: str) -> list[str]:
    """Pieces of a camel-case word (of query text, on the driver)."""
    import re

    return [x for x in re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=.)(?=[A-Z][a-z])", "\0", text).split("\0") if x]


def parts_in_order(value: Column, parts: list[str]) -> Column:
    """Whether all parts occur one after another, without regard to case."""
    import re

    return F.lower(value).rlike(".*".join(re.escape(p.lower()) for p in parts)) if parts else F.lit(False)
