"""Language profiles: which suffixes, how declarations begin, how imports and packages are written."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from corpusframe.operators.imports import READERS

_ID = r"[A-Za-z_$][\w$]*"
_WORD = r"[^\W\d][\w$]*"  # an identifier of any alphabet
_DOTTED = rf"{_WORD}(?:\s*\.\s*{_WORD})*"
_TICKED = rf"(?:{_WORD}|`[^`\n]+`)"  # or anything between back-ticks
_TICKED_PATH = rf"{_TICKED}(?:\.{_TICKED})*"


@dataclass(frozen=True)
class LanguageProfile:
    """`declarations` are (kind, pattern) with groups name and optionally bases; bodies are in braces, or by indentation.  Imports and package are
    patterns here, or have a reader in `imports.READERS`."""

    name: str
    suffixes: tuple[str, ...]
    declarations: tuple[tuple[str, str], ...] = field(default=())
    imports: str = ""
    package: str = ""
    indented: bool = False
    #: Whether names of imports stand in strings; else they are looked for where strings and comments are blanked out.
    quoted: bool = False


def _bases(word: str) -> str:
    return rf"(?:\s*{word}\s*(?P<bases>[^{{]+?))?"


_SCRIPT = (
    ("class", rf"\bclass\s+(?P<name>{_ID})(?:<[^>{{]*>)?(?:\s+(?:extends|implements)\s+(?P<bases>[^{{]+?))?\s*(?={{)"),
    ("function", rf"\bfunction\s*\*?\s*(?P<name>{_ID})\s*(?:<[^>]*>)?\([^)]*\)[^{{;]*(?={{)"),
    ("method", rf"(?:^|(?<=[{{}};]))[ \t]*(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b|function\b|return\b|do\b|else\b){_ID})\s*(?:<[^>]*>)?\([^)]*\)\s*(?::\s*[^{{;=]+)?(?={{)"),
)
_TYPED = _SCRIPT + (("interface", rf"\binterface\s+(?P<name>{_ID})(?:<[^>{{]*>)?(?:\s+extends\s+(?P<bases>[^{{]+?))?\s*(?={{)"), ("enum", rf"\benum\s+(?P<name>{_ID})\s*(?={{)"))
_C_FUNCTION = rf"^(?!\s*(?:if|for|while|switch|return|else|do)\b)[\w\s*&:<>,~]*?\b(?P<name>~?{_ID}(?:::~?{_ID})*)\s*\([^;{{}}]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?={{)"

PROFILES = (
    # `import`, perhaps `static`, a dotted name that may end in a star, a semicolon; blanks may stand anywhere between
    LanguageProfile("java", (".java",), imports=rf"\bimport\b(?:\s+static\b)?\s+({_DOTTED}(?:\s*\.\s*\*)?)\s*;", package=rf"\bpackage\s+({_DOTTED})\s*;"),
    LanguageProfile("python", (".py", ".pyi"), indented=True),  # the parser knows its imports
    LanguageProfile("typescript", (".ts",), _TYPED),
    LanguageProfile("tsx", (".tsx",), _TYPED),
    LanguageProfile("javascript", (".js", ".jsx", ".mjs", ".cjs"), _SCRIPT),
    LanguageProfile(
        "go",
        (".go",),
        (("class", rf"\btype\s+(?P<name>{_ID})(?:\[[^\]]*\])?\s+(?:struct|interface)\s*(?={{)"), ("function", rf"^func\s+(?:\([^)]*\)\s*)?(?P<name>{_ID})(?:\[[^\]]*\])?\s*\([^{{]*(?={{)")),
    ),
    LanguageProfile(
        "c_sharp",
        (".cs",),
        (
            ("class", rf"\b(?:class|struct|record)\s+(?P<name>{_ID})(?:<[^>{{]*>)?{_bases(':')}\s*(?={{)"),
            ("interface", rf"\binterface\s+(?P<name>{_ID})(?:<[^>{{]*>)?{_bases(':')}\s*(?={{)"),
            ("enum", rf"\benum\s+(?P<name>{_ID})[^{{]*(?={{)"),
            ("method", rf"^[ \t]*(?:(?:public|private|protected|internal|static|async|virtual|override|sealed|abstract)\s+)+[\w<>\[\],.? ]*?(?P<name>{_ID})\s*\([^)]*\)[^{{;]*(?={{)"),
        ),
        # a using directive: perhaps global, static or unsafe, perhaps an alias, and a name; neither a using statement nor a declaration
        rf"\busing\s+(?:(?:static|unsafe)\s+)*(?:{_WORD}\s*=\s*)?((?:global\s*::\s*)?{_DOTTED})\s*(?:<[^;()]*>)?\s*;",
        rf"\bnamespace\s+({_DOTTED})\s*[;{{]",
    ),
    LanguageProfile(
        "rust",
        (".rs",),
        (("class", rf"\b(?:struct|impl(?:<[^>]*>)?(?:\s+[\w:<>]+\s+for)?)\s+(?P<name>{_ID})[^;{{]*(?={{)"), ("interface", rf"\btrait\s+(?P<name>{_ID})[^;{{]*(?={{)"), ("enum", rf"\benum\s+(?P<name>{_ID})[^;{{]*(?={{)"), ("function", rf"\bfn\s+(?P<name>{_ID})[^;{{]*(?={{)")),
    ),
    LanguageProfile("c", (".c", ".h"), (("class", rf"\bstruct\s+(?P<name>{_ID})\s*(?={{)"), ("enum", rf"\benum\s+(?P<name>{_ID})\s*(?={{)"), ("function", _C_FUNCTION))),
    LanguageProfile("cpp", (".cpp", ".cc", ".cxx", ".hpp", ".hh"), (("class", rf"\b(?:class|struct)\s+(?P<name>{_ID}){_bases(':')}\s*(?={{)"), ("enum", rf"\benum\s+(?:class\s+)?(?P<name>{_ID})[^;{{]*(?={{)"), ("function", _C_FUNCTION))),
    LanguageProfile("ruby", (".rb",), (("class", rf"^\s*class\s+(?P<name>[\w:]+)(?:\s*<\s*(?P<bases>[\w:]+))?"), ("class", r"^\s*module\s+(?P<name>[\w:]+)"), ("function", r"^\s*def\s+(?P<name>[\w.]+[?!=]?)")), indented=True),
    LanguageProfile(
        "kotlin", (".kt", ".kts"), (("class", rf"\b(?:class|object|interface)\s+(?P<name>{_ID})(?:<[^>{{]*>)?(?:\([^)]*\))?{_bases(':')}\s*(?={{)"), ("function", rf"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?(?P<name>{_ID})\s*\([^{{=]*(?={{)")), rf"(?m)^[ \t]*import[ \t]+({_TICKED_PATH}(?:\.\*)?)(?=[ \t]*(?:;|$|as\b))", rf"(?m)^[ \t]*package[ \t]+({_TICKED_PATH})", quoted=True
    ),
    LanguageProfile(
        "scala", (".scala",), (("class", rf"\b(?:class|object)\s+(?P<name>{_ID})(?:\[[^\]]*\])?(?:\([^)]*\))?(?:\s+extends\s+(?P<bases>[^{{]+?))?\s*(?={{)"), ("interface", rf"\btrait\s+(?P<name>{_ID})(?:\[[^\]]*\])?(?:\s+extends\s+(?P<bases>[^{{]+?))?\s*(?={{)"), ("function", rf"\bdef\s+(?P<name>{_ID})[^{{\n]*(?={{)")), r"(?m)^[ \t]*import[ \t]+(.+?)[ \t]*;?[ \t]*$", rf"(?m)^[ \t]*package[ \t]+(?!object\b)({_TICKED_PATH})"
    ),
)
BY_SUFFIX = {s: p for p in PROFILES for s in p.suffixes}
BY_NAME = {p.name: p for p in PROFILES}


def imports_of(profile: LanguageProfile, text: str, blanked: str) -> list[str]:
    """The names that a source text imports, in order; `blanked` is the text without strings and comments."""
    if profile.name in READERS:
        return list(dict.fromkeys(x for x in READERS[profile.name][0](text) if x))
    found = [m[1] for m in re.finditer(profile.imports, text if profile.quoted else blanked)] if profile.imports else []
    if profile.name == "scala":
        found = [name for clause in found for name in scala_names(clause)]
    return list(dict.fromkeys(x if profile.quoted else re.sub(r"\s+", "", x).strip("`") for x in found))


def package_of(profile: LanguageProfile, text: str, blanked: str) -> str:
    if profile.name in READERS:
        return READERS[profile.name][1](text)
    m = re.search(profile.package, blanked) if profile.package else None
    return re.sub(r"\s+", "", m[1]) if m else ""


def scala_names(clause: str) -> list[str]:
    """What an import clause names: paths between commas, each perhaps with selectors in braces, which may rename or hide."""
    out = []
    for part in re.findall(r"[^,{]+(?:\{[^}]*\})?", clause):
        path, _, selectors = part.strip().partition("{")
        names = [re.split(r"=>|\bas\b", x)[0].strip() for x in selectors.rstrip("} ").split(",") if x.strip() and not re.search(r"(?:=>|\bas\b)\s*_", x)]
        path = re.split(r"\bas\b", path)[0].strip()
        out += [path.rstrip(".") + "." + n for n in names] if selectors else [path] if path else []
    return out


def all_suffixes() -> list[str]:
    """The base suffixes and those of all profiles."""
    from corpusframe.functions.paths import SUFFIXES

    return list(dict.fromkeys([*SUFFIXES, *BY_SUFFIX]))
