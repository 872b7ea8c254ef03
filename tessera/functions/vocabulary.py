"""Category ids, one-hot domains, rule table, names in scope. Order is part of their meaning."""

#: categories of the multi-hot label, with and without the year
CATEGORIES = ["SC01", "SC03", "SC04", "SC05", "SC06", "SC08", "SC09", "SC10"]
CATEGORY_YEAR = ":2025"

CFG_SUB_TYPES = ["entry_point", "expression", "return", "if", "new variable", "inline asm", "end inline asm", "if_loop", "end_if", "begin_loop", "end_loop", "throw", "break", "continue", "try", "catch", "other_entrypoint", "other"]
AST_SUB_TYPES = [
    "functiondefinition", "contractdefinition", "ifstatement", "whilestatement", "forstatement", "block", "expressionstatement", "variabledeclarationstatement", "return",
    "assignment", "binaryoperation", "unaryoperation", "functioncall", "identifier", "literal", "memberaccess", "indexaccess", "typeconversion", "throw", "revert", "assert", "require",
    "inheritance", "modifierinvocation", "arraytype", "mapping", "newexpression", "tupleexpression", "variabledeclaration", "modifierdefinition", "eventdefinition", "structdefinition",
    "enumdefinition", "usingfordirective", "parameterlist", "other",
]
VARIABLE_VISIBILITY = ["private", "public", "internal"]
FUNCTION_VISIBILITY = ["private", "internal", "external", "public"]
STORAGE = ["memory", "storage", "calldata", "none"]
MUTABILITY = ["pure", "view", "nonpayable", "payable", "none"]
EVENT = ["anonymous", "non-anonymous", "indexed", "override", "virtual", "returns", "none"]
CONTRACT_KIND = ["library", "interface", "abstract", "contract", "none"]
CFG_FLAGS = ["expression_has_require", "expression_has_revert", "expression_is_call_like", "node_is_branch_like", "node_is_terminator", "node_is_callsite"]
CFG_COUNTERS = ["ir_line_count", "ir_instruction_count", "ir_unique_var_count", "ir_edge_count", "ir_call_count", "ir_assign_count", "ir_phi_count", "ir_return_count", "ir_condition_count", "ir_tmp_ref_count", "ir_def_count", "ir_use_count"]

#: (rule, pattern, severity, name) of the source scan
RULES = [
    ("SWC-101", r"(\+\+|--|\+|\-|\*|/|\*\*)\s*(?!SafeMath)", "High", "Integer Overflow and Underflow"),
    ("SWC-105", r"\.transfer\(|\.send\(", "Critical", "Unprotected Ether Withdrawal"),
    ("SWC-107", r"\.call\{value:|\.call\.value\(", "Critical", "Reentrancy"),
    ("SWC-112", r"delegatecall\(", "High", "Delegatecall to Untrusted Callee"),
    ("SWC-115", r"tx\.origin", "Medium", "Authorization through tx.origin"),
    ("SWC-120", r"block\.(timestamp|number|difficulty|blockhash)", "Medium", "Weak Sources of Randomness"),
    ("SWC-131", r"(?:uint|int|bool|address|string)\s+(\w+)\s*;", "Low", "Presence of unused variables"),
]

#: category of each rule, and of any other
RULE_CATEGORIES = {"SWC-101": "A9", "SWC-105": "A5", "SWC-107": "A9", "SWC-112": "A9", "SWC-115": "A5", "SWC-120": "A9", "SWC-131": "A10"}
NO_CATEGORY = "Unknown"

#: names of the analyser log's findings that are in scope
LOG_FINDINGS = ["Callstack Depth Attack Vulnerability", "Transaction-Ordering Dependency", "Timestamp Dependency", "Re-Entrancy Vulnerability", "Integer Overflow", "Integer Underflow", "Parity Multisig Bug 2"]

#: operators that make an assignment a binary operation, in the order they are looked for
BINARY_OPERATORS = ["&&", "||", "==", "!=", ">=", "<=", "+", "-", "*", "/", "%", ">", "<"]
CALL_WORDS = ["CALL", "INTERNAL_CALL", "LIBRARY_CALL", "MODIFIER_CALL", "SOLIDITY_CALL", "LOW_LEVEL_CALL"]
KEYWORDS = ["REQUIRE", "REVERT", "ASSERT", "EMIT", "LOG", "LOW_LEVEL_CALL"]
NOT_VARIABLES = ["CONDITION", "END_IF", "_", "False", "True", "RETURN"]
