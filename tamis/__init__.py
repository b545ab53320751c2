"""tamis: declarative data-quality rules on Spark DataFrames."""

from .capabilities import CAPABILITIES, detect_engine, get_capabilities, has_capability, list_engines_with_capability, require_capability
from .export import OpenMetadataExport
from .functions.predicates import register_rule, register_table_rule, unregister_rule
from .operators.metric_states import MetricStates, metric_states
from .operators.observed import ObservedValidation, validate_and_write
from .operators.profile import profile, profile_df
from .operators.pushdown import jdbc_runner, polled_runner, validate_pushed
from .operators.schema_contract import ColumnDef, SchemaDef, SchemaReport, extract_schema, validate_schema
from .operators.validate import validate
from .plans.sqlgen import compile_rules_to_sql, get_validation_sql, transpile
from .report import ValidationLevel, ValidationReport, ValidationResult, ValidationStatus
from .rules import RuleDefinition, list_rules
from .sources.excel import read_excel
from .sources.rules_store import load_rules, load_rules_csv, save_rules_csv
from .sources.tables import load_data, load_jdbc, load_table, save_data
from .sources.warehouses import Warehouse, warehouse
from .streaming.seen import count_late, flag_seen, keyed_state
from .streaming.stream import StreamValidation, read_committed, validate_stream, windowed_metrics

__all__ = [
    "CAPABILITIES", "ColumnDef", "MetricStates", "ObservedValidation", "OpenMetadataExport", "RuleDefinition", "SchemaDef", "SchemaReport", "StreamValidation", "ValidationLevel", "ValidationReport", "ValidationResult",
    "ValidationStatus", "Warehouse", "compile_rules_to_sql", "count_late", "detect_engine", "extract_schema", "flag_seen", "get_capabilities", "get_validation_sql", "has_capability", "jdbc_runner", "keyed_state",
    "list_engines_with_capability", "list_rules", "load_data", "load_jdbc", "load_rules", "load_rules_csv", "load_table", "metric_states", "polled_runner", "profile", "profile_df", "read_committed", "read_excel", "register_rule",
    "register_table_rule", "require_capability", "save_data", "save_rules_csv", "transpile", "unregister_rule", "validate", "validate_and_write", "validate_pushed", "validate_schema", "validate_stream", "warehouse", "windowed_metrics",
]
