"""Regular expressions and fixed word lists shared by the Spark plans and the oracle SQL.

Every pattern stays in the subset that Java regex and RE2 read the same way
(no look-around, no possessive quantifiers), so an oracle can repeat it.
"""

from __future__ import annotations

# --- line classification -------------------------------------------------
IDENT = r"[A-Za-z_][A-Za-z0-9_]*"
FIRST_WORD = r"^([A-Za-z_]+)"
ASYNC_WORD = r"^async\s+([a-z]+)"
AUG_ASSIGN = r"^[A-Za-z_][A-Za-z0-9_.]*(\[[^\]]*\])?\s*(\+|-|\*|/|//|%|\*\*|&|\||\^|>>|<<|@)="
ASSIGN = r"^[A-Za-z_][A-Za-z0-9_.]*(\[[^\]]*\])?(\s*,\s*[A-Za-z_][A-Za-z0-9_.]*)*\s*(:[^=]+)?=[^=]"
TRAILING_COMMENT = r"\s+#[^\"']*$"

# Statement keywords recognised as their own statement kind.
KEYWORD_KINDS = [
    "def", "class", "if", "elif", "else", "for", "while", "try", "except", "finally",
    "with", "return", "raise", "import", "from", "assert", "pass", "break", "continue",
    "yield", "global", "nonlocal", "del", "await", "lambda", "match", "case",
]
# Kinds that open an indented block.
HEADER_KINDS = ["def", "class", "if", "elif", "else", "for", "while", "try", "except", "finally", "with", "match", "case"]
# Blocks counted by the nesting metric (the twelve syntax kinds of the reference map to these
# line kinds plus comprehension / lambda lines, see metrics.py).
NEST_KINDS = ["if", "elif", "else", "for", "while", "try", "except", "finally", "with"]
# Blocks counted by cognitive nesting (with-blocks do not deepen it).
COG_NEST_KINDS = ["if", "elif", "else", "for", "while", "try", "except", "finally"]
LOOP_KINDS = ["for", "while"]

# --- definitions ---------------------------------------------------------
DEF_NAME = r"^(async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)"
DEF_PARAMS = r"\((.*)\)"
DEF_RETURN = r"\)\s*->\s*([^:]+):"
CLASS_NAME = r"^class\s+([A-Za-z_][A-Za-z0-9_]*)"
CLASS_BASES = r"^class\s+[A-Za-z_][A-Za-z0-9_]*\s*\((.*)\)\s*:"
PARAM_NAME = r"^\s*(\*{0,2}[A-Za-z_][A-Za-z0-9_]*)"
PARAM_HINT = r":\s*([^=]+)"
MUTABLE_DEFAULT = r"=\s*[\[{]"
IMPORT_LINE = r"^import\s+(.+)$"
FROM_LINE = r"^from\s+([A-Za-z0-9_.]+)\s+import\s+\(?([^)]*)\)?$"

# --- calls and names ----------------------------------------------------
CALL = r"([A-Za-z_][A-Za-z0-9_.]*)\s*\("
NAME_TOKEN = r"[A-Za-z_][A-Za-z0-9_]*"
DECISION_WORDS = r"\b(if|elif|for|while|except|and|or)\b"
BOOL_WORDS = r"\b(and|or)\b"
COMPREHENSION = r"[\[{(][^\]})]*\sfor\s[^\]})]*\sin\s"
LAMBDA = r"\blambda\b"
NUMBER = r"(^|[^A-Za-z0-9_.])(-?[0-9]+(\.[0-9]+)?)"
STRING_LITERAL = r"\"[^\"]*\"|'[^']*'"

# Built-in names (shadowing check).
BUILTINS = [
    "abs", "all", "any", "ascii", "bin", "bool", "bytearray", "bytes", "callable",
    "chr", "classmethod", "compile", "complex", "delattr", "dict", "dir", "divmod",
    "enumerate", "eval", "exec", "filter", "float", "format", "frozenset", "getattr",
    "globals", "hasattr", "hash", "help", "hex", "id", "input", "int", "isinstance",
    "issubclass", "iter", "len", "list", "locals", "map", "max", "memoryview", "min",
    "next", "object", "oct", "open", "ord", "pow", "print", "property", "range",
    "repr", "reversed", "round", "set", "setattr", "slice", "sorted", "staticmethod",
    "str", "sum", "super", "tuple", "type", "vars", "zip",
]

# Command-execution calls.
COMMAND_CALLS = ["os.system", "subprocess.call", "subprocess.run", "subprocess.Popen", "os.popen"]
