"""Schemas that operators read and write; repo_id is the partition key of all."""

OBJECTS = "repo_id string, oid string, type string, size long, content binary, storage string"
PACK_ENTRIES = "repo_id string, pack string, offset long, oid string, type string, size long, base_offset long, base_oid string, data binary"
PACK_INDEX = "repo_id string, pack string, oid string, offset long"
REFS = "repo_id string, name string, oid string, symref_target string, source string"
COMMITS = "repo_id string, oid string, tree string, parents array<string>, author_time long, committer_time long, message string"
TAGS = "repo_id string, oid string, target_oid string"
TREE_ENTRIES = "repo_id string, tree_oid string, ordinal int, mode string, name string, oid string"
TREE_FILES = "repo_id string, root_tree string, path string, depth int, mode string, oid string"
FILE_CHANGES = "repo_id string, kind string, path string, old_oid string, new_oid string"
LINE_OPS = "array<struct<op:string,a_idx:int,b_idx:int>>"
BLAME_LINES = "repo_id string, path string, line_no int, line string, blame_oid string"
COMMIT_INDEX = "repo_id string, oid string, tree string, committer_time long, parents array<string>, changed_paths array<string>, bloom binary, ref_tips_digest string"

#: Fixed values of the object format: entry modes and their names.
TREE_MODES = {"100644": "file", "100755": "executable", "120000": "symlink", "40000": "directory", "160000": "submodule"}
OBJECT_TYPES = ("blob", "tree", "commit", "tag")

#: Limits, all of them options of the readers.
LIMITS = {"loose_object_max": 64 << 20, "pack_file_max": 512 << 20, "pack_object_max": 64 << 20, "index_file_max": 256 << 20, "delta_depth_max": 50, "symref_depth_max": 5, "tree_depth_max": 1024}
