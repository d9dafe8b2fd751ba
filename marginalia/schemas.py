"""Schemas of the record store's tables and of their JSON columns."""

TABLES = {
    "jobs": "id string, created_at timestamp_ntz, status string, name string, rubric string, question_text string, essay_format string, student_count int, knowledge_base_topic string, custom_scrub_words array<string>, archived boolean",
    "essays": "id bigint, job_id string, student_name string, raw_text string, scrubbed_text string, normalized_text string, evaluation string, grade string, status string, metadata string",
    "reports": "id bigint, job_id string, report_type string, essay_id bigint, filename string, content binary, created_at timestamp_ntz",
    "latex_artifacts": "artifact_name string, template_used string, title string, content binary, size_bytes bigint, created_at timestamp_ntz",
    "scrub_batches": "id string, created_at timestamp_ntz, status string, name string, custom_scrub_words array<string>, archived boolean",
    "scrubbed_documents": "id bigint, batch_id string, student_name string, raw_text string, scrubbed_text string, status string, metadata string",
    "email_logs": "id bigint, job_id string, report_type string, student_name string, email_address string, status string, reason string, subject string, template_used string, sent_at timestamp_ntz",
    "bubble_tests": "id string, name string, created_at timestamp_ntz, status string, description string, metadata string, archived boolean",
    "bubble_sheets": "id bigint, test_id string, paper_size string, num_questions int, id_length int, id_orientation string, draw_border boolean, layout_json string, pdf_content binary, created_at timestamp_ntz",
    "answer_keys": "id bigint, test_id string, created_at timestamp_ntz, key_data string, total_points double",
    "grading_jobs": "id string, test_id string, created_at timestamp_ntz, status string, scan_pdf binary, num_pages int, num_students int, error_message string",
    "student_responses": "id bigint, job_id string, page_number int, student_id string, answers_json string, score double, percent_grade double, scan_status string, scan_warnings array<string>",
    "grading_reports": "id bigint, job_id string, report_type string, filename string, content binary, created_at timestamp_ntz",
    "regrade_jobs": "id string, created_at timestamp_ntz, updated_at timestamp_ntz, status string, name string, class_name string, assignment_title string, due_date string, rubric string, question_text string, knowledge_base_topic string, metadata string, archived boolean",
    "regrade_essays": "id bigint, job_id string, student_identifier string, essay_text string, evaluation string, grade string, status string, teacher_grade string, teacher_comments string, teacher_annotations string",
    "test_jobs": "id string, created_at timestamp_ntz, status string, name string, description string, knowledge_topic string, total_questions int, total_points double, difficulty string, grade_level string, question_distribution string, focus_topics string, source_weighting string, include_word_bank boolean, include_rubrics boolean, generated_test string, generated_key string, metadata string, archived boolean",
    "test_questions": "id bigint, job_id string, question_number int, question_type string, question_text string, options string, correct_answer string, distractors_rationale string, model_answer string, rubric string, points double, difficulty string, source_reference string, status string, regeneration_count int",
    "test_materials": "id bigint, job_id string, file_path string, file_name string, content_preview string, content_type string, ingested_at timestamp_ntz",
}

#: Children of each table: (table, foreign key), removed before it.
CHILDREN = {
    "jobs": [("reports", "job_id"), ("essays", "job_id")],
    "scrub_batches": [("scrubbed_documents", "batch_id")],
    "bubble_tests": [("answer_keys", "test_id"), ("bubble_sheets", "test_id")],
    "grading_jobs": [("student_responses", "job_id"), ("grading_reports", "job_id")],
    "regrade_jobs": [("regrade_essays", "job_id")],
    "test_jobs": [("test_questions", "job_id"), ("test_materials", "job_id")],
}

EVALUATION = "struct<criteria: array<struct<name: string, score: string, feedback: struct<explanation: string, justification: string, examples: array<string>, advice: string, rewritten_example: string>>>, overall_score: string, summary: string>"
COMMENTS = "struct<teacher_notes: string, refined_teacher_notes: string, report_generated: boolean, criteria_overrides: array<struct<name: string, score: string>>>"
ANSWER_KEY = "array<struct<question: string, answer: string, points: double>>"
ANSWERS = "map<string, string>"
HIGHLIGHT = "struct<quote: string, category: string, suggestion: string>"
OPTIONS = "array<struct<letter: string, text: string>>"
