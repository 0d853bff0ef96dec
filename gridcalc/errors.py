"""Errors that formulas and sheets raise."""


class GridError(Exception):
    """Base of all errors of this library."""


class FormulaSyntaxError(GridError):
    """The formula's text can't be read."""


class FormulaNotSupported(GridError):
    """The formula uses a kind of literal or operand that is not supported."""


class FunctionNotSupported(GridError):
    """No function or operator has that name."""


class InvalidArguments(GridError):
    """A function is called with arguments that it doesn't take."""


class InvalidReference(GridError):
    """A reference lies outside the sheet."""


class InvalidArithmeticInput(GridError):
    """A range stands where a single value is needed."""


class AxisNotSupported(GridError):
    """Formulas are filled down rows only."""


class SheetConfigError(GridError):
    """A sheet's source, key or order is not usable."""
