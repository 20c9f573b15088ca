"""Readers and writers: delimited text, landmark text, OBJ, PLY and the chunked binary format."""
