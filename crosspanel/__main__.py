"""Studies by name: ``python -m crosspanel evaluate preds=path/to/preds.parquet cap=0.8 [--out folder]``.

Values are Python literals where they can be read as such (0.8, 5, True, (1, 5)), else texts; a name given twice, or one
whose value has commas in square brackets, is a list. Each table of the result is shown, or written to ``--out``.
"""

from __future__ import annotations

import ast
import sys

from pyspark.sql import SparkSession

from .reports import STUDIES


def parsed(given: list[str]) -> dict:
    out: dict = {}
    for pair in given:
        name, sign, text = pair.partition("=")
        if not sign:
            raise SystemExit(f"{pair}: options are written name=value")
        try:
            value = ast.literal_eval(text)
        except (ValueError, SyntaxError):
            value = text
        out[name] = value if name not in out else [*(out[name] if isinstance(out[name], list) else [out[name]]), value]
    return out


def main(words: list[str], spark: SparkSession | None = None) -> None:
    if not words or words[0] not in STUDIES:
        raise SystemExit(f"studies: {', '.join(STUDIES)}\n\n{__doc__}")
    folder = None
    if "--out" in words:
        at = words.index("--out")
        folder = words[at + 1]
        words = words[:at] + words[at + 2 :]
    spark = spark or SparkSession.builder.appName("crosspanel").getOrCreate()
    for name, table in STUDIES[words[0]](spark, **parsed(words[1:])).items():
        if folder:
            table.write.mode("overwrite").parquet(f"{folder}/{name}")
        else:
            print(name)
            table.show(200, truncate=False)


if __name__ == "__main__":
    main(sys.argv[1:])
