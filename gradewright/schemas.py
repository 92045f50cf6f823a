"""Spark schemas of the records that the operators exchange."""

FILE_CHANGE = (
    "struct<filename string, status string, additions bigint, deletions bigint, "
    "changes bigint, patch string, old_filename string>"
)
FILE_CHANGES = f"array<{FILE_CHANGE}>"
COMMIT = "struct<sha string, message string, date string, author string>"

RELEASE_PAYLOAD = (
    "tag_name string, name string, body string, published_at string, "
    "target_commitish string, author struct<login string>"
)
REPO_PAYLOAD = (
    "full_name string, stargazers_count bigint, size bigint, topics array<string>, "
    "language string, archived boolean, disabled boolean, fork boolean"
)
PR_PAYLOAD = (
    "number bigint, title string, body string, state string, merged boolean, "
    "base struct<sha string>, head struct<sha string>"
)
PR_FILE_PAYLOAD = (
    "struct<filename string, status string, additions bigint, deletions bigint, "
    "changes bigint, patch string, previous_filename string>"
)
COMMIT_PAYLOAD = "sha string, commit struct<message string, author struct<name string, date string>>"

PR_ANALYSIS = (
    "struct<pr_number string, base_commit struct<sha string, date string>, "
    f"detailed_description string, file_changes {FILE_CHANGES}, "
    "test_files array<string>, non_test_files array<string>>"
)
ENHANCED_FEATURE = (
    "struct<feature_type string, description string, feature_detailed_description string, "
    f"pr_analyses array<{PR_ANALYSIS}>>"
)
RESULT_ENTRY = (
    "struct<repository string, release string, analyzed_at string, "
    f"enhanced_new_features array<{ENHANCED_FEATURE}>>"
)
RESULTS_DOCUMENT = (
    "metadata struct<generated_at string, total_repositories bigint, total_releases bigint, "
    f"total_enhanced_features bigint>, results array<{RESULT_ENTRY}>"
)

INSTANCE_COLUMNS = [
    "repo",
    "instance_id",
    "base_commit",
    "patch",
    "test_patch",
    "problem_statement",
    "hints_text",
    "created_at",
    "version",
    "org",
    "number",
    "PASS_TO_PASS",
    "FAIL_TO_PASS",
    "test_files",
]
INSTANCE = (
    f"repo string, instance_id string, base_commit string, patch {FILE_CHANGES}, "
    f"test_patch {FILE_CHANGES}, problem_statement string, hints_text string, "
    "created_at string, version string, org string, number bigint, PASS_TO_PASS string, "
    "FAIL_TO_PASS string, test_files array<string>, processed boolean, docker_image string"
)

FEATURE_ITEM = "array<struct<description string, pr_ids array<string>>>"
FEATURE_REPLY = (
    f"new_features {FEATURE_ITEM}, improvements {FEATURE_ITEM}, "
    f"bug_fixes {FEATURE_ITEM}, other_changes {FEATURE_ITEM}, _corrupt_record string"
)
