"""Schemas of the stored tables."""

from __future__ import annotations

METADATA = "struct<visibility:string,async:boolean,static:boolean,abstract:boolean,virtual:boolean,decorators:array<string>,modifiers:array<string>,scope:string,git_remote:string,git_branch:string,git_commit:string,is_workspace_root:boolean,is_publishable:boolean,manifest_path:string>"
NODES = f"id string, name string, node_type string, kind string, subtype string, file string, line int, end_line int, text string, hash string, metadata {METADATA}, span_start int, span_end int, root string, partition_id string"
EDGES = "source string, target string, edge_type string, ref_line int, ident string, version_spec string, is_dev_dependency boolean, src_partition string, dst_partition string"
FILES = "path string, sha256 string, n_bytes bigint, language string, root string"
POINTS = "repo_id string, point_id bigint, entity_id string, name string, type string, kind string, subtype string, file_path string, start_line int, end_line int, content string, vector array<float>"
COMPONENTS = "node_id string, name string, manifest_path string, directory string, ecosystem string, version string, is_workspace_root boolean, workspace_members array<string>, local_dependencies array<struct<name:string,path:string,dep_type:string,is_dev:boolean,is_build:boolean,version_spec:string>>"
VERSION = "1.2"
