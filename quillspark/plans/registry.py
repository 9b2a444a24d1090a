"""Languages and dictionaries: small dimension tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Language:
    name: str
    ids: tuple[str, ...]
    extensions: tuple[str, ...]
    dictionaries: tuple[str, ...] = ()


def _of(name: str, ids: str, extensions: str, dictionaries: str = "") -> Language:
    return Language(name, tuple(ids.split(",")), tuple(extensions.split(",")), tuple(filter(None, dictionaries.split(","))))


#: Name, identifiers, extensions, dictionaries. The order breaks ties.
LANGUAGES = (
    _of("Rust", "rust", "rs", "rust"),
    _of("C", "c", "c,h", "c"),
    _of("Cpp", "cpp,c++", "cpp,cc,cxx,hpp,hh,hxx,cppm,ixx,mxx", "cpp"),
    _of("Elixir", "elixir", "ex,exs", "elixir"),
    _of("Erlang", "erlang", "erl,hrl", "erlang"),
    _of("Python", "python,python3", "py", "python"),
    _of("Java", "java", "java", "java"),
    _of("Javascript", "javascript,javascriptreact,jsx,node", "js,jsx", "javascript,javascriptreact"),
    _of("Just", "just,justfile", "just,justfile,Justfile"),
    _of("Latex", "latex", "tex,latex,ltx", "latex"),
    _of("Typescript", "typescript", "ts", "typescript"),
    _of("Tsx", "typescriptreact,tsx", "tsx", "typescriptreact"),
    _of("Haskell", "hs", "hs", "haskell"),
    _of("HTML", "html,vue,vue.js,astro,svelte", "html,htm,vue,astro,svelte", "html"),
    _of("Css", "css", "css", "css"),
    _of("Dart", "dart", "dart", "dart"),
    _of("Go", "go", "go", "go"),
    _of("Swift", "swift", "swift", "swift"),
    _of("TOML", "toml", "toml", "toml"),
    _of("Ruby", "ruby", "rb", "ruby"),
    _of("Lua", "lua", "lua", "lua"),
    _of("Markdown", "markdown", "md,markdown"),
    _of("Bash", "bash,shellscript,sh,shell script,shell,zsh,fish", "sh,bash", "bash"),
    _of("OCaml", "ocaml", "ml,mli", "ocaml"),
    _of("Odin", "odin", "odin", "odin"),
    _of("Php", "php", "php", "php"),
    _of("R", "r", "r,R", "r"),
    _of("YAML", "yaml,yml", "yaml,yml", "yaml"),
    _of("Zig", "zig", "zig", "zig"),
    _of("CSharp", "csharp", "cs", "csharp"),
    _of("Typst", "typst", "typ", "typst"),
    _of("VHDL", "vhdl", "vhd,vhdl", "vhdl"),
)
#: Dictionaries with affixes, lists of words, and those every text is checked with.
AFFIX_IDS = (
    "en_us", "en", "en_gb", "cs", "es", "de", "de_at", "de_ch", "fr", "ru", "it", "sv", "pt_br", "nl_nl",
    "da", "lv", "la", "sa", "grc", "vi_vn", "pl", "uk", "nb_no", "nn_no", "pt_pt", "pt", "fa_ir", "sl",
)
LIST_IDS = ("dart", "go", "rust", "software_terms", "computing_acronyms", "builtin", "csharp")
ALWAYS = ("builtin", "software_terms", "computing_acronyms")
TRANSLITERATED = ("de", "de_at", "de_ch")


def language_of_id(name: str | None) -> str:
    """The first language with the name among its ids or extensions; all others are Text."""
    return next((x.name for x in LANGUAGES if name in x.ids or name in x.extensions), "Text")


def language_of_path(path: str | None) -> str:
    name = (path or "").replace("\\", "/").rsplit("/", 1)[-1].rsplit(".", 1)[-1]
    return next((x.name for x in LANGUAGES if name in x.extensions), "Text")


def languages_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, x.name, list(x.ids), list(x.extensions), list(x.dictionaries)) for k, x in enumerate(LANGUAGES)], "ordinal int, language string, ids array<string>, extensions array<string>, dictionaries array<string>")


def path_key(path: Column) -> Column:
    """What decides a path's language: after the last dot of the last segment."""
    return F.substring_index(F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1), ".", -1)


def _lookup(key: Column, ids: bool) -> Column:
    names: dict[str, str] = {}
    for x in LANGUAGES:
        for n in (*(x.ids if ids else ()), *x.extensions):
            names.setdefault(n, x.name)
    table = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit("Text"))


def of_path(path: Column) -> Column:
    """Case-sensitive; a map literal, as the registry is a fixed few dozen rows."""
    return _lookup(path_key(path), False)


def resolve(language: Column, path: Column) -> Column:
    """A language that is given counts, even if it is unknown; else the path's; else Text."""
    return F.when(language.isNotNull(), _lookup(language, True)).when(path.isNotNull(), of_path(path)).otherwise("Text")


def registry_table(spark: SparkSession) -> DataFrame:
    """(dictionary, kind, transliterated); affix dictionaries come first where an id is both."""
    rows = [(x, "affix", x in TRANSLITERATED) for x in AFFIX_IDS] + [(x, "list", False) for x in LIST_IDS if x not in AFFIX_IDS]
    return spark.createDataFrame(rows, "dictionary string, kind string, transliterated boolean")


def dictionary_kind(name: str) -> str | None:
    return "affix" if name in AFFIX_IDS else "list" if name in LIST_IDS else None


def dictionaries_for(languages: DataFrame, base: tuple[str, ...]) -> DataFrame:
    """(key, language) -> (key, dictionary): base, every-text and language dictionaries that exist."""
    spark = languages.sparkSession
    own = languages_table(spark).select("language", F.explode("dictionaries").alias("dictionary"))
    fixed = F.array(*[F.lit(x) for x in dict.fromkeys((*base, *ALWAYS))])
    key = languages.columns[0]
    wanted = languages.select(key, F.explode(fixed).alias("dictionary")).union(languages.join(F.broadcast(own), "language").select(key, "dictionary"))
    return wanted.distinct().join(F.broadcast(registry_table(spark)), "dictionary").select(key, "dictionary", "kind", "transliterated")
