"""Statements over a Unix socket: one session, one client at a time.

    python -m vectide.server /tmp/vectide.sock [root]

A client sends a statement as a line of UTF-8. The reply is the lines that it prints, each behind a space and sent as
its rows come, then a line ``ok``, or ``error`` with the reason. ``shutdown`` keeps all tables and ends the server.
"""

from __future__ import annotations

import os
import socket
import sys
from collections.abc import Iterator

from pyspark.sql import SparkSession

from vectide.errors import VectideError
from vectide.session import Session


def serve(path: str, session: Session) -> None:
    """Answers clients, one after the other, until one of them says shutdown."""
    with socket.socket(socket.AF_UNIX, socket.SOCK_STREAM) as door:
        door.bind(path)
        door.listen()
        try:
            while _answer(door.accept()[0], session):
                pass
        finally:
            os.unlink(path)


def _answer(client: socket.socket, session: Session) -> bool:
    """Serves a client until it leaves. False: it said shutdown."""
    with client, client.makefile("r", encoding="utf-8") as asked, client.makefile("w", encoding="utf-8") as told:
        for line in asked:
            try:
                for row in session.stream(line.rstrip("\n")):
                    told.write(f" {row}\n")
                told.write("ok\n")
            except VectideError as e:
                told.write(f"error {type(e).__name__}: {e}\n")
            told.flush()
            if line.strip() == "shutdown":
                return False
    return True


class Client:
    """``ask`` gives the printed lines of a statement; an error of the server is raised as VectideError."""

    def __init__(self, path: str):
        self.socket = socket.socket(socket.AF_UNIX, socket.SOCK_STREAM)
        self.socket.connect(path)
        self.told = self.socket.makefile("r", encoding="utf-8")

    def ask(self, statement: str) -> Iterator[str]:
        self.socket.sendall(f"{statement}\n".encode())
        for line in self.told:
            line = line.rstrip("\n")
            if not line.startswith(" "):
                if line != "ok":
                    raise VectideError(line.removeprefix("error "))
                return
            yield line[1:]

    def close(self) -> None:
        self.told.close()
        self.socket.close()


if __name__ == "__main__":
    serve(sys.argv[1], Session(SparkSession.builder.getOrCreate(), *sys.argv[2:3]))
