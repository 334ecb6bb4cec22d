"""Files and folders as tables, and tables as files."""

from .files import file_sizes, globbed, held_files, read_contents, read_line_table, read_object_table, read_tsv_table, size_of, write_contents, write_tsv_table

__all__ = ["file_sizes", "globbed", "held_files", "read_contents", "read_line_table", "read_object_table", "read_tsv_table", "size_of", "write_contents", "write_tsv_table"]
