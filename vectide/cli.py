"""Runs statements from the standard input: ``python -m vectide.cli [root]``."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from vectide.errors import VectideError
from vectide.session import Session


def main(lines, root: str | None = None, out=sys.stdout, err=sys.stderr) -> None:
    session = Session(SparkSession.builder.getOrCreate(), root)
    for line in lines:
        try:
            for text in session.stream(line):
                print(text, file=out)
        except VectideError as e:
            print(f"{type(e).__name__}: {e}", file=err)
            continue
        if line.strip() == "shutdown":
            break


if __name__ == "__main__":
    main(sys.stdin, *sys.argv[1:2])
