"""Columns of the method dataset, and thresholds."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

#: Column of the dataset and header of the export, in the export's order; None: not exported.
METHOD_COLUMNS = [
    ("id", "ID"),
    ("project", "PROJECT"),
    ("relative_path", "FILE"),
    ("function_name", "FUNCTION"),
    ("function_type", "FUNCTION_TYPE"),
    ("start_line", "START_LINE"),
    ("end_line", "END_LINE"),
    ("loc", "LOC"),
    ("span_loc", "SPAN_LOC"),
    ("comment_lines", "COMMENT_LINES"),
    ("blank_lines", "BLANK_LINES"),
    ("cyclo", "CYCLO"),
    ("max_nesting", "MAXNESTING"),
    ("nop", "NOP"),
    ("nolv", "NOLV"),
    ("cond_ops_max", "CONDOPS_MAX"),
    ("cond_nesting", "COND_NESTING"),
    ("num_conditions", "NUM_CONDITIONS"),
    ("atfd", "ATFD"),
    ("laa", "LAA"),
    ("fdp", "FDP"),
    ("foreign_providers", "FOREIGN_PROVIDERS"),
    ("foreign_member_calls", "FOREIGN_MEMBER_CALLS"),
    ("foreign_call_providers", "FOREIGN_CALL_PROVIDERS"),
    ("is_long_method", "is_long_method"),
    ("is_complex_method", "is_complex_method"),
    ("is_complex_conditional", "is_complex_conditional"),
    ("is_feature_envy", "is_feature_envy"),
    ("is_smelly", "is_smelly"),
    ("smell_count", "SMELL_COUNT"),
    ("smell_types", "SMELL_TYPES"),
    ("file_name", None),
    ("start_offset", None),
    ("end_offset", None),
    ("source", None),
]
#: Label column, name shown, and name in the export, in order.
SMELLS = [
    ("is_long_method", "Long Method", "LongMethod"),
    ("is_complex_method", "Complex Method", "ComplexMethod"),
    ("is_complex_conditional", "Complex Conditional", "ComplexConditional"),
    ("is_feature_envy", "Feature Envy", "FeatureEnvy"),
]
IGNORED_FOLDERS = ("node_modules", "dist", "build", "coverage")
DEFAULT_PROJECT = "javascript-project"
SNIPPET = "pasted-snippet.js"
PAGE = 100


@dataclass(frozen=True)
class Thresholds:
    long_loc: int = 31
    long_compound: bool = False
    long_cyclo: int = 10
    long_nesting: int = 5
    complex_cyclo: int = 10
    conditional_ops: int = 5
    few: int = 3

    def updated(self, name: str, value: object) -> Thresholds:
        """With ``name`` set from user input: text counts up to its first non-digit; what isn't above 0 changes nothing."""
        import re

        if name not in {f.name for f in fields(self)}:
            raise KeyError(name)
        if name == "long_compound":
            return replace(self, long_compound=bool(value))
        found = re.match(r"\s*([+-]?\d+)", str(value))
        return replace(self, **{name: int(found[1])}) if found and int(found[1]) > 0 else self
