"""Reading exports, knowing files, writing outputs."""
