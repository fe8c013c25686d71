"""Where tables come from."""

from tallymark.sources.specs import Spec, parse_spec, redact
from tallymark.sources.readers import FORMATS, Table, open_table, probe

__all__ = ["FORMATS", "Spec", "Table", "open_table", "parse_spec", "probe", "redact"]
