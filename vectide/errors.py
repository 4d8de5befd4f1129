"""The errors that a statement can raise."""


class VectideError(Exception):
    """Base of all."""


class ParseError(VectideError):
    """The text is not a statement of the language."""


class UnknownObject(VectideError):
    """No such database, table or column."""


class UnknownVariable(VectideError):
    """No vector or scalar has this name."""


class LengthMismatch(VectideError):
    """Vectors that have to be aligned differ in length."""


class ArityError(VectideError):
    """A row does not have as many values as the table has columns."""
