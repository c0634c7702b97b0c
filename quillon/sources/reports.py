"""Text reports: tables, boxes, data dictionaries and sections that are replaced in place. Small results, on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def markdown_table(df: DataFrame, order: list[str], *, digits: int = 4, most: int = 1000) -> str:
    """A pipe table of all rows in an order; more than `most` rows is an error, as a report is read by people."""
    cell = lambda v: "n/a" if v is None or v != v else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", r"\|").replace("\n", " ")
    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table has at most {most} rows")
    lines = [df.columns, ["---"] * len(df.columns), *[[cell(v) for v in r] for r in rows]]
    return "".join(f"| {' | '.join(x)} |\n" for x in lines)


def spread_text(median: float | None, iqr: float | None, digits: int = 4) -> str:
    return "n/a" if median is None or iqr is None else f"{median:.{digits}f} (IQR {iqr:.{digits}f})"


def box(lines: list[str], width: int = 78) -> str:
    """Lines in a frame, cut to its width."""
    edge = "+" + "-" * (width - 2) + "+\n"
    return edge + "".join(f"| {x[: width - 4]:<{width - 4}} |\n" for x in lines) + edge


def splice(text: str, begin: str, end: str, section: str, anchor: str, *, before: bool = False) -> str:
    """text with a section (which holds its own markers): in place of the present one, else at the anchor, else at the end.

    Doing it again with the same section changes nothing.
    """
    head, found, rest = text.partition(begin)
    if found and end in text:
        return head + section + text.split(end)[1]
    head, found, rest = text.partition(anchor)
    if found:
        return f"{head}{section}\n{anchor}{rest}" if before else f"{head}{anchor}\n{section}\n{rest}"
    return text.rstrip("\n") + f"\n\n{section}\n"


def described(df: DataFrame, meaning: dict[str, tuple[str, str]]) -> DataFrame:
    """df whose columns carry who makes them and what they mean, as metadata; every column must be described."""
    missing = [c for c in df.columns if c not in meaning]
    if missing:
        raise ValueError(f"columns without a description: {missing}")
    return df.select(*[F.col(c).alias(c, metadata={"producer": meaning[c][0], "comment": meaning[c][1]}) for c in df.columns])


def data_dictionary(df: DataFrame) -> DataFrame:
    """column, type, producer, meaning of every described column, in their order."""
    rows = [(i, f.name, f.dataType.simpleString(), f.metadata.get("producer"), f.metadata.get("comment")) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string, producer string, meaning string")
