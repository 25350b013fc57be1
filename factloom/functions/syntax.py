"""What syntax nodes count as, given as columns of a node table: kinds of occurrences, roles of children,
and values that literals fold to. Nodes come from a parser; nothing is parsed here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Node kinds and what they count as.
OCCURRENCES = {
    "import": ["ImportDeclaration", "ImportEqualsDeclaration", "ImportSpecifier"],
    "export": ["ExportDeclaration", "ExportAssignment", "ExportSpecifier"],
    "call": ["CallExpression"],
    "construction": ["NewExpression"],
    "render": ["JsxOpeningElement", "JsxSelfClosingElement"],
    "access": ["PropertyAccessExpression", "ElementAccessExpression"],
}
BODIES = {
    "statement": ["Block", "EmptyStatement", "VariableStatement", "ExpressionStatement", "BreakStatement", "ContinueStatement", "LabeledStatement", "TryStatement", "WithStatement", "DebuggerStatement"],
    "declaration": ["VariableDeclaration"],
    "assignment": ["PropertyAssignment", "ShorthandPropertyAssignment"],
    "expression": ["ObjectLiteralExpression", "ArrayLiteralExpression", "PropertyAccessExpression", "ElementAccessExpression", "StringLiteral", "NoSubstitutionTemplateLiteral", "NumericLiteral", "TrueKeyword", "FalseKeyword", "BinaryExpression"],
    "call": ["CallExpression"],
    "return": ["ReturnStatement"],
    "throw": ["ThrowStatement"],
    "branch": ["IfStatement", "ConditionalExpression", "SwitchStatement", "ForStatement", "ForInStatement", "ForOfStatement", "WhileStatement", "DoStatement"],
}
#: Kind of the parent -> the field of it that a child fills -> the child's role; # stands for its place.
ROLES = {
    "CallExpression": {"expression": "callee", "typeArguments": "type-argument:#", "arguments": "argument:#"},
    "ObjectLiteralExpression": {"properties": "property:#"},
    "PropertyAssignment": {"name": "name", "initializer": "initializer"},
    "VariableDeclaration": {"name": "name", "initializer": "initializer"},
    "ReturnStatement": {"expression": "expression"},
    "ThrowStatement": {"expression": "expression"},
    "ConditionalExpression": {"condition": "condition", "whenTrue": "when-true", "whenFalse": "when-false"},
    "BinaryExpression": {"left": "left", "right": "right"},
    "IfStatement": {"expression": "condition", "thenStatement": "then", "elseStatement": "else"},
}
OPAQUE = ["CallExpression", "NewExpression", "TaggedTemplateExpression", "FunctionDeclaration", "FunctionExpression", "ArrowFunction", "MethodDeclaration", "Constructor", "GetAccessor", "SetAccessor"]


def _by(value: Column, names: dict[str, list[str]]) -> Column:
    """The name whose list holds the value; null for none."""
    pairs = [F.lit(x) for name, kinds in names.items() for kind in kinds for x in (kind, name)]
    return F.element_at(F.create_map(*pairs), value)


def occurrence_kind(kind: Column) -> Column:
    return _by(kind, OCCURRENCES)


def body_kind(kind: Column, operator: Column) -> Column:
    """A binary expression with an assigning operator is an assignment."""
    assigns = operator.rlike(r"^(?:[-+*/%&|^]|\*\*|<<|>>>?|&&|\|\||\?\?)?=$")
    return F.when((kind == "BinaryExpression") & F.coalesce(assigns, F.lit(False)), "assignment").otherwise(_by(kind, BODIES))


def child_role(parent: Column, field: Column, place: Column, index: Column) -> Column:
    """The role of a child that fills `field` of its parent, at `place` where the field is a list; a child
    in no such field is known by its `index` among all children."""
    pairs = [F.lit(x) for kind, fields in ROLES.items() for name, role in fields.items() for x in (f"{kind}.{name}", role)]
    role = F.element_at(F.create_map(*pairs), F.concat_ws(".", parent, field))
    return F.coalesce(F.replace(role, F.lit("#"), place.cast("string")), F.concat(F.lit("child:"), index.cast("string")))


def literal(kind: Column, text: Column) -> Column:
    """struct(kind, value, reason) of a node by itself: a literal is known, as JSON under v; what calls or makes
    something or is a function is unsupported; a missing node and all others are unknown."""
    number = text.try_cast("double")
    value = (
        F.when(kind.isin("StringLiteral", "NoSubstitutionTemplateLiteral"), F.to_json(F.struct(text.alias("v"))))
        .when((kind == "NumericLiteral") & number.isNotNull(), F.to_json(F.struct(number.alias("v"))))
        .when(kind == "TrueKeyword", F.lit('{"v":true}'))
        .when(kind == "FalseKeyword", F.lit('{"v":false}'))
    )
    state = F.when(kind.isNull(), "unknown").when(value.isNotNull(), "known").when(kind.isin(OPAQUE), "unsupported").otherwise("unknown")
    reason = F.when(kind.isNull(), "VALUE_ABSENT").when(state == "unknown", "DYNAMIC_EXPRESSION")
    return F.struct(state.alias("kind"), value.alias("value"), reason.alias("reason"))


def conditional(yes: Column, no: Column) -> Column:
    """struct(kind, values, reason) of a conditional by what its two branches fold to: the same known value
    is known, two are ambiguous, anything else is unknown."""
    both = (yes["kind"] == "known") & (no["kind"] == "known")
    same = yes["value"] == no["value"]
    kind = F.when(both & same, "known").when(both, "ambiguous").otherwise("unknown")
    values = F.when(both & same, F.array(yes["value"])).when(both, F.array(yes["value"], no["value"])).otherwise(F.array().cast("array<string>"))
    return F.struct(kind.alias("kind"), values.alias("values"), F.when(kind == "ambiguous", "CONDITIONAL_BRANCH").when(kind == "unknown", "DYNAMIC_EXPRESSION").alias("reason"))
