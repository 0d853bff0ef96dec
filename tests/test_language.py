import pytest

from gridcalc.errors import AxisNotSupported, FormulaNotSupported, FormulaSyntaxError, FunctionNotSupported, InvalidArguments, InvalidArithmeticInput, InvalidReference
from gridcalc.plans.analyze import check, functions
from gridcalc.plans.parser import parse
from gridcalc.plans.tree import Call, Literal, Ref, RefType, column_index, column_letters, parse_reference


@pytest.mark.parametrize("text,corners,kind", [
    ("A1", (0, 0, 0, 0), RefType.RR), ("$B$3:c$5", (2, 1, 4, 2), RefType.FF), ("A$1:B3", (0, 0, 2, 1), RefType.FR), ("A1:$B$9", (0, 0, 8, 1), RefType.RF), ("AA10:AB12", (9, 26, 11, 27), RefType.RR), ("$A1", (0, 0, 0, 0), RefType.RR),
])
def test_references(text, corners, kind):
    r = parse_reference(text)
    assert (r.row, r.column, r.last_row, r.last_column) == corners
    assert r.kind is kind


def test_letters_round_trip():
    assert [column_letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(column_index(column_letters(i)) == i for i in range(2000))


def show(node):
    if isinstance(node, Call):
        return f"{node.name}({','.join(map(show, node.args))})"
    return node.text if isinstance(node, Ref) else str(node.value)


@pytest.mark.parametrize("formula,precedence,tree", [
    ("=A1+B1*C1", "flat", "*(+(A1,B1),C1)"), ("=A1+B1*C1", "excel", "+(A1,*(B1,C1))"), ("=-A1+B1", "flat", "NEGATE(+(A1,B1))"), ("=-A1+B1", "excel", "+(NEGATE(A1),B1)"),
    ("=(A1+B1)*2", "flat", "*(+(A1,B1),2.0)"), ("=IF(A1>=1,\"a\"\"b\",NULL)", "flat", 'IF(>=(A1,1.0),a"b,None)'), ("= sum( A1:B2 , 1 )", "flat", "SUM(A1:B2,1.0)"), ("=2^3^A1", "excel", "^(^(2.0,3.0),A1)"),
    ("=ceiling.math(A1,.5,TRUE)", "flat", "CEILING.MATH(A1,0.5,True)"), ("=50%+A1", "flat", "+(%(50.0),A1)"), ("=LOG10(A1)", "flat", "LOG10(A1)"), ("=A1&\"x\"=B1", "excel", "=(&(A1,x),B1)"), ("=1.5e3", "flat", "1500.0"),
])
def test_trees(formula, precedence, tree):
    assert show(parse(formula, precedence)) == tree


@pytest.mark.parametrize("formula,error", [
    ("A1", FormulaSyntaxError), ("=A1+", FormulaSyntaxError), ("=SUM(A1", FormulaSyntaxError), ("=(A1", FormulaSyntaxError), ("=A1 B1", FormulaSyntaxError), ('="x', FormulaSyntaxError), ("=foo", FormulaSyntaxError), ("=A1:B", FormulaSyntaxError),
    ("=#N/A", FormulaNotSupported), ("={1,2}", FormulaNotSupported), ("=A0", InvalidReference), ("=", FormulaSyntaxError), ("=SUM(A1;B1)", FormulaSyntaxError), ("=Sheet1!A1", FormulaSyntaxError), ("=)", FormulaSyntaxError),
])
def test_unreadable(formula, error):
    with pytest.raises(error):
        parse(formula)


@pytest.mark.parametrize("formula,error", [
    ("=NOSUCH(A1)", FunctionNotSupported), ("=A11", InvalidReference), ("=F1", InvalidReference), ("=A1:B2+1", InvalidArithmeticInput), ("=ABS(A1:A2)", InvalidArithmeticInput), ("=MEDIAN(A1,B1)", InvalidArguments), ("=MEDIAN(3)", InvalidArguments),
    ("=SUMIF(A1:A3,B1)", InvalidArguments), ('=SUMIF(A1:A3,">1",B1:C3)', InvalidArguments), ("=IF(A1,B1)", InvalidArguments), ("=ABS()", InvalidArguments), ("=LOOKUP(A1,B$1:B$2,C$1:C$2)", InvalidArguments), ("=GREATEST(A1,B1)", FunctionNotSupported),
])
def test_faults(formula, error):
    with pytest.raises(error):
        check(parse(formula), 10, 5)


def test_fill_down_only():
    with pytest.raises(AxisNotSupported):
        parse("=A1", axis="column")


def test_every_function_of_the_inventory_is_there():
    names = (
        "SUM COUNT AVERAGE MIN MAX + - * / SUMIF MEDIAN CONCAT CONCATENATE EXACT FIND LEFT LEN LOWER MID REPLACE RIGHT TRIM UPPER VALUE ABS ACOS ACOSH ACOT ACOTH ARABIC ASIN ASINH ATAN ATANH COS COSH COT COTH CSC CSCH "
        "DEGREES EVEN EXP FACT FACTDOUBLE INT ISEVEN ISODD LN LOG10 NEGATE ODD RADIANS SEC SECH SIGN SIN SINH SQRT SQRTPI TAN TANH ATAN2 DECIMAL MOD MROUND POWER RANDBETWEEN CEILING CEILING.MATH CEILING.PRECISE "
        "FLOOR FLOOR.MATH FLOOR.PRECISE ROMAN ROUND ROUNDDOWN ROUNDUP TRUNC COUNTIF AVERAGEIF MAXIF MINIF IF > = < VLOOKUP HLOOKUP LOOKUP MATCH INDEX"
    ).split()
    assert len(names) == 92
    assert not set(names) - functions()


def test_literal_equality():
    assert Literal(1.0, "1") == Literal(1.0, "1")
