"""Column-level functions: every public function maps Columns to a Column."""
