"""Files of the shared folder from tasks and commits, on any store that pyarrow knows by its URI."""

from __future__ import annotations

import json

from pyarrow import fs


class Store:
    """A folder: names are relative to it. A file is whole or not there, since it is written aside and then moved."""

    def __init__(self, path: str):
        self.files, self.root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)
        self.root = self.root.rstrip("/")

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def has(self, name: str) -> bool:
        return self.files.get_file_info(self.at(name)).type != fs.FileType.NotFound

    def names(self, folder: str) -> list[str]:
        """Names of the files in a folder, sorted."""
        found = self.files.get_file_info(fs.FileSelector(self.at(folder), allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.File)

    def writer(self, name: str):
        self.files.create_dir(self.at(name).rsplit("/", 1)[0], recursive=True)
        return self.files.open_output_stream(self.at(name), compression=None)

    def reader(self, name: str):
        return self.files.open_input_stream(self.at(name), compression=None)

    def move(self, name: str, to: str) -> None:
        self.files.create_dir(self.at(to).rsplit("/", 1)[0], recursive=True)
        self.files.move(self.at(name), self.at(to))

    def put(self, name: str, document: object) -> None:
        """A small JSON document, whole at once."""
        with self.writer(f"{name}.new") as out:
            out.write(json.dumps(document, sort_keys=True).encode())
        self.move(f"{name}.new", name)

    def get(self, name: str) -> object:
        with self.reader(name) as source:
            return json.loads(source.read())

    def drop(self, name: str) -> None:
        kind = self.files.get_file_info(self.at(name)).type
        if kind == fs.FileType.Directory:
            self.files.delete_dir(self.at(name))
        elif kind == fs.FileType.File:
            self.files.delete_file(self.at(name))
