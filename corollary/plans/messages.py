"""Parts of messages that hosts match on."""

# The wording is a contract with hosts.
REDEFINES_FACTS = "redefines a fact relation"
REDEFINES_BUILTIN = "redefines a built-in relation"
REDEFINES_DERIVED = "redefines a derived relation registered in module"
QUALIFIED_HEAD = "is a qualified path; a query defines only its own bare relations, and a shared one is registered with AddModule"
MODULE_NOT_RELATION = "is a module, not a relation"
UNSHARED_NEGATION = "shares no variable with the rest"
OPEN_NEGATION = "appears only inside the `not`, so the negation has nothing to range over and matches either every row or none"
UNBOUND_OPERAND = "comparison operand is unbound (a variable must appear in a relation before it is compared)"
ALL_BOUND = "needs all arguments bound (a variable must appear in a relation before"
NOTHING_BINDS = "nothing binds what"
NEEDS_FIRST = "needs first"
ARITY = "args (arity must be consistent)"
ONLY_RULE = "aggregates, so it must be the relation's only rule"
FUNCTIONS = "want count/min/max/sum/list"
HEAD_UNBOUND = "is not bound by a positive body relation"
NOT_STRATIFIABLE = "rules are not stratifiable"
UNBOUND_AGGREGATE = "which no relation binds"
UNBOUND_COLUMN = "is not bound by a positive relation (a variable used only under negation is existential and cannot be selected)"
TWO_AGGREGATES = "having compares two aggregates"
NO_GROUP_KEY = "which is not a group key \u2014 after grouping only a selected variable or a constant is bound"
NO_ANSWER_COLUMN = "which is not an answer column (sort on a column the projection selects)"
NEGATIVE_COUNT = "a row count can't be negative"
ONE_OF_TWO = "exactly one of Holds and Gen"
NO_MODES = "declares no Modes"
