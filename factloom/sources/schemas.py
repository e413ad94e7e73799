"""Fact tables as DDL. Text is never null: empty means missing."""

FACTS = {
    "files": "path string, hash string, language string, status string, category string",
    "symbols": "path string, name string, qualified_name string, kind string, canonical_id string, parent string, start_line int, end_line int, decorators array<string>, signature string, parameter_count int, return_type string, documentation string, body_hash string",
    "imports": "path string, module string, name string, alias string, level int, line int",
    "calls": "path string, caller string, callee string, line int, arguments array<string>",
    "inheritance": "path string, child string, parent string, line int",
    "bindings": "path string, scope string, name string, line int, kind string, source string, conditional boolean",
    "routes": "path string, framework string, method string, route string, handler string, line int",
    "mounts": "path string, parent string, child string, prefix string, line int",
    "tables": "path string, dialect string, table_name string, column_name string, data_type string, nullable boolean, primary_key boolean, target string, line int",
    "queries": "path string, caller string, operation string, relationship string, table_name string, sql string, line int",
    "edges": "source string, target string, relationship string, confidence string, evidence_class string, path string, line int, reason string",
}
