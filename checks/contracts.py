"""Declared columns of every registered query: name:kind (s text, l integer, d double, b flag, t time)."""

CONTRACTS = {
    "model_prices": "model:s model_norm:s provider:s p_input:d p_cache_read:d p_cache_write_5m:d p_cache_write_1h:d p_output:d",
    "calls_priced": "session_id:s seq:l agent:s model:s model_norm:s provider:s is_priced:b month:t c5m_tokens:l c1h_tokens:l ctx_tokens:l input_usd:d cache_read_usd:d cache_write_usd:d output_usd:d cost_usd:d",
    "session_price": "session_model:s session_id:s session_provider:s p_input:d p_cache_read:d p_cache_write_5m:d p_output:d",
    "calls_idx": "session_id:s seq:l call_idx:l cum_cost_usd:d cost_usd:d",
    "seq_pos": "session_id:s seq:l calls_before:l cum_cost_usd:d tools_before:l",
    "sessions_x": "session_id:s agent:s repo:s mode:s harness_version:s user_hash:s session_model:s p_input:d n_calls:l n_sidechain_calls:l n_fast_calls:l session_cost_usd:d output_tokens:l ctx_tokens:l n_tool_calls:l n_tool_errors:l n_human_turns:l n_interrupts:l committed_lines:l",
    "turns": "session_id:s turn_idx:l user_seq:l user_ts:t next_user_seq:l next_user_ts:t n_calls:l last_call_seq:l last_call_ts:t turn_cost_usd:d last_call_seq_adj:l last_call_ts_adj:t prev_last_call_ts_adj:t",
    "c01_headline": "pool_of_writes_on_known_files:l content_chars_in_pool:l output_usd_in_pool:d sessions_in_pool:l median_content_chars:d",
    "c01_rewrite_necessary": "session_id:s seq:l k_before:l k_after:l agent:s mode:s repo:s file_path:s content_chars:l input_chars:l max_earlier_read_chars:l rewrite_ratio:d output_usd_estimate:d stratum_pick:s stratum:s",
    "c02_headline": "pool_of_tool_results:l results_over_5k_chars:l rent_usd_in_pool:d sessions_in_pool:l median_result_chars:d",
    "c02_tool_result_used": "session_id:s seq:l k_before:l k_after:l agent:s mode:s repo:s tool_kind:s tool_name:s what:s result_chars:l later_calls:l rent_tokens:d rent_usd:d stratum_pick:s stratum:s",
    "c03_headline": "hot_files_selected:l sessions_covered:l edits_covered:l max_sessions_on_one_file:l min_sessions_on_one_file:l",
    "c03_hot_file_cause": "session_id:s seq:l k_before:l k_after:l agent:s mode:s repo:s file_path:s tool_kind:s file_sessions:l file_edits:l file_users:l stratum:s",
    "code_survival": "agent:s mode:s sessions:l gen_lines_est:d committed_lines:l pct_survive_est:d usd:d usd_per_committed_line:d",
    "concurrent_files": "repo:s file_path:s overlapping_session_pairs:l",
    "concurrent_summary": "overlapping_pairs:l sessions_involved:l files_with_overlap:l files_edited_total:l",
    "sleep_durations": "sleep_bucket:s calls:l usd_context:d hours_slept:d",
    "survival_distribution_vibe": "bucket:s sessions:l",
    "t01_by_agent": "agent:s sessions:l calls:l usd:d input_tokens:l cache_read_tokens:l cache_write_tokens:l output_tokens:l ctx_tokens:l pct_of_total_usd:d",
    "t01_by_model": "model:s provider:s calls:l sessions:l usd:d input_usd:d cache_read_usd:d cache_write_usd:d output_usd:d",
    "t01_components_by_agent": "agent:s usd:d input_usd:d cache_read_usd:d cache_write_usd:d output_usd:d pct_input:d pct_cache_read:d pct_cache_write:d pct_output:d",
    "t01_headline": "total_usd:d usd_claude_code:d usd_codex:d usd_opencode:d pct_usd_cache_read:d pct_usd_cache_write:d pct_usd_output:d pct_usd_fresh_input:d pct_calls_unpriced:d usd_per_committed_line_all:d",
    "t01_per_committed_line_by_agent_mode": "agent:s mode:s sessions:l usd:d committed_lines:l usd_per_committed_line:d",
    "t01_per_committed_line_by_mode": "mode:s sessions:l usd:d committed_lines:l usd_per_committed_line:d ctx_tokens_per_committed_line:d output_tokens_per_committed_line:d",
    "t01_unpriced_models": "model:s calls:l ctx_tokens:l output_tokens:l",
    "t01_unpriced_share": "agent:s calls:l unpriced_calls:l all_tokens:l unpriced_tokens:l pct_calls_unpriced:d pct_tokens_unpriced:d",
    "t01_usd_per_session": "agent:s sessions:l mean_usd:d max_usd:d p50_usd:d p90_usd:d p99_usd:d",
    "t02_break_rate_fine_grained": "gap_bucket:s calls:l break_rate_pct:d cache_write_usd:d",
    "t02_by_gap_bucket": "gap_bucket:s calls:l breaks:l break_rate_pct:d recached_tokens:l recached_tokens_on_breaks:l cache_write_usd:d cache_write_usd_on_breaks:d median_gap_min:d pct_of_calls:d",
    "t02_gap_gt_5min_by_month": "month:t calls_after_gap_gt_5min:l cache_write_usd_after_gap_gt_5min:d pct_of_month_cache_write_usd:d",
    "t02_headline": "usd_recached_after_gap_gt_5min:d break_rate_pct_gap_lt_1min:d break_rate_pct_gap_gt_60min:d recached_tokens_after_gap_gt_5min:l pct_of_all_cache_write_usd:d pct_of_total_usd:d",
    "t02_ttl_era_by_month": "month:t calls:l cache_write_5m_tokens:l cache_write_1h_tokens:l pct_tokens_1h:d cache_write_usd:d break_rate_pct:d",
    "t03_by_agent": "agent:s tool_results:l repeated_results:l pct_results_repeated:d result_chars:l repeated_chars:l pct_chars_repeated:d",
    "t03_by_tool_kind": "agent:s tool_kind:s tool_results:l repeated_results:l pct_results_repeated:d repeated_chars:l pct_chars_repeated:d",
    "t03_headline": "pct_of_tool_result_chars_exact_repeats:d repeated_tool_results:l pct_of_tool_results_repeated:d repeated_chars:l usd_lower_bound_fresh_input:d",
    "t03_top_repeated_bash_commands": "command_head_90:s repeated_occurrences:l sessions:l repeated_chars:l",
    "t03_top_repeated_files": "file_path_90:s tool_kind:s repeated_occurrences:l sessions:l repeated_chars:l",
    "t03_usd_by_agent": "agent:s repeated_chars:l repeated_tokens:d usd_lower_bound:d usd_if_cached_once:d",
    "t03_worst_offender_sessions": "session_id:s agent:s repeated_results:l repeated_chars:l max_times_same_result:l",
    "t04_by_result_size_bucket": "size_bucket:s tool_results:l result_chars:l avg_later_calls:d rent_tokens:d rent_usd:d pct_of_results:d pct_of_result_chars:d pct_of_rent_usd:d",
    "t04_by_tool_kind": "agent:s tool_kind:s tool_results:l result_chars:l avg_later_calls:d rent_tokens:d rent_usd:d",
    "t04_headline": "rent_usd_claude_code:d rent_usd_all_agents_upper_bound:d rent_usd_from_results_over_10k_chars:d pct_of_rent_from_results_over_10k:d pct_of_results_over_10k_chars:d rent_tokens_all_agents_upper_bound:d pct_of_claude_code_cache_read_tokens_from_tool_results:d",
    "t04_rent_vs_actual_cache_read": "agent:s rent_tokens:d rent_usd:d cache_read_tokens:l cache_read_usd:d pct_of_cache_read_tokens:d pct_of_cache_read_usd:d",
    "t04_top20_single_results_by_rent": "session_id:s seq:l agent:s tool_kind:s what:s result_chars:l later_calls:l rent_tokens:d rent_usd:d",
    "t05_by_agent_month": "agent:s month:t sessions:l total_entry_usd:d median_entry_tokens:d p90_entry_tokens:d median_entry_usd:d",
    "t05_claude_code_by_version": "harness_version:s vkey:s sessions:l total_entry_usd:d median_entry_tokens:d p90_entry_tokens:d median_entry_usd:d",
    "t05_codex_by_version": "harness_version:s vkey:s sessions:l total_entry_usd:d median_entry_tokens:d p90_entry_tokens:d median_entry_usd:d",
    "t05_headline": "first_claude_code_version:s median_entry_tokens_first_version:d last_claude_code_version:s median_entry_tokens_last_version:d pct_change_in_median_entry_tokens:d median_entry_usd_last_version:d total_entry_usd_all_sessions:d pct_of_total_usd:d",
    "t05_totals_by_agent": "agent:s sessions:l total_entry_tokens:l total_entry_usd:d median_entry_tokens:d pct_of_total_usd:d",
    "t06_by_agent": "agent:s calls:l truncated_calls:l pct_calls_truncated:d usd_of_continuation_input:d continuation_ctx_tokens:l",
    "t06_by_model": "model:s stop_reason:s truncated_calls:l sessions:l avg_output_tokens:d usd_of_continuation_input:d",
    "t06_headline": "truncated_calls:l pct_of_all_calls_truncated:d sessions_affected:l usd_paid_to_resume_after_truncation:d pct_of_total_usd:d",
    "t06_stop_reason_distribution": "agent:s stop_reason:s calls:l pct_of_agent_calls:d",
    "t07_by_agent": "agent:s file_tool_calls:l missing_path_errors:l pct_missing_path:d sessions_affected:l usd_of_next_3_calls:d",
    "t07_by_model": "model:s file_tool_calls:l missing_path_errors:l pct_missing_path:d usd_of_next_3_calls:d",
    "t07_by_tool_kind": "agent:s tool_kind:s calls:l missing_path_errors:l pct_missing_path:d",
    "t07_headline": "missing_path_errors:l pct_of_file_tool_calls:d sessions_affected:l usd_of_the_next_3_calls_after_the_error:d pct_of_total_usd:d",
    "t07_top_missing_paths": "file_path_80:s errors:l sessions:l",
    "t08_by_agent": "agent:s tool_calls:l ceremony_calls:l pct_of_tool_calls:d todo_tokens:d task_tokens:d ceremony_usd:d",
    "t08_by_agent_and_kind": "agent:s tool_kind:s calls:l tokens:d usd:d median_input_chars:d",
    "t08_headline": "ceremony_tool_calls:l pct_of_all_tool_calls:d output_tokens_spent_on_ceremony:d ceremony_usd:d pct_of_all_output_usd:d",
    "t08_sessions_with_vs_without": "mode:s kind:s sessions:l pct_sessions_with_commits:d usd:d committed_lines:l usd_per_committed_line:d",
    "t09_by_agent": "agent:s polling_calls:l sessions:l usd_of_the_calls_that_issued_them:d ctx_tokens:l bash_calls:l pct_of_bash_calls:d",
    "t09_headline": "polling_bash_calls:l sessions_that_poll:l usd_of_calls_that_issued_a_poll:d polls_inside_a_burst:l usd_in_bursts:d pct_of_all_bash_calls:d pct_of_total_usd:d",
    "t09_polling_sequences": "burst:s polling_calls:l usd:d ctx_tokens:l",
    "t09_top_polling_commands": "command_head_80:s polling_calls:l sessions:l usd:d",
    "t10_big_old_string_edits": "agent:s edits:l edits_old_string_over_1500:l pct:d old_string_chars:l usd_old_string:d usd_old_string_all_edits:d",
    "t10_headline": "usd_output_writes_to_files_already_in_context:d writes_on_known_files:l pct_of_writes_on_known_files:d output_tokens_rewritten:d median_json_overhead_ratio:d pct_of_all_output_usd:d usd_old_string_quotes_over_1500_chars:d",
    "t10_json_overhead_for_writes": "agent:s writes:l extra_tokens_vs_bare_content:d median_json_overhead_ratio:d p90_json_overhead_ratio:d",
    "t10_rewrite_ratio_distribution": "bucket:s writes:l content_tokens:d usd:d median_content_chars:d",
    "t10_top_rewritten_files": "file_path_80:s agent:s writes_on_known_file:l content_chars:l usd:d",
    "t10_writes_on_known_files": "agent:s writes:l writes_on_known_files:l pct_writes_on_known_files:d output_tokens_on_known_files:d usd_on_known_files:d usd_all_writes:d",
    "t11_by_agent": "agent:s final_replies:l unread_replies:l pct_replies_unread:d final_text_tokens:d unread_text_tokens:d pct_text_tokens_unread:d unread_usd:d median_read_time_s:d median_delta_s:d",
    "t11_by_reply_length": "length_bucket:s final_replies:l pct_unread:d text_tokens:d unread_usd:d",
    "t11_delta_vs_read_time_distribution": "bucket:s final_replies:l text_tokens:d usd:d median_text_chars:d pct_of_replies:d",
    "t11_headline": "usd_final_text_that_could_not_be_read:d pct_of_final_text_tokens_unread:d unread_replies:l final_replies_measured:l median_seconds_before_next_prompt:d median_seconds_needed_to_read:d pct_of_all_output_usd:d",
    "t11_longest_unread_replies": "session_id:s turn_idx:l agent:s n_text_chars:l read_time_s:d delta_s:d text_usd:d",
    "t11_ordering_diagnostic": "agent:s turns_with_a_next_prompt:l turns_dropped_no_call_before_next_prompt:l turns_where_last_call_ts_was_after_next_prompt:l median_raw_delta_s:d median_adjusted_delta_s:d",
    "t12_agent_time_buckets": "bucket:s turns:l agent_hours:d usd:d pct_of_turns:d",
    "t12_by_agent": "agent:s turns:l agent_hours:d human_wait_hours:d usd:d usd_per_agent_hour:d median_agent_time_s:d p90_agent_time_s:d median_human_time_s:d",
    "t12_by_mode": "mode:s turns:l agent_hours:d human_wait_hours:d token_usd:d human_usd_if_watching_at_60ph:d ratio_wait_cost_to_token_cost:d median_agent_time_s:d",
    "t12_headline": "total_agent_working_hours:d total_token_usd_in_those_turns:d human_usd_at_60_per_hour_if_watching:d ratio_human_wait_cost_to_token_cost:d total_human_typing_and_thinking_hours:d usd_of_tokens_per_agent_hour:d median_agent_seconds_per_turn:d",
    "t12_per_session": "agent:s sessions:l agent_hours:d usd:d median_agent_hours_per_session:d p90_agent_hours_per_session:d median_human_hours_per_session:d",
    "t13_by_agent": "agent:s outcome:s sessions:l usd:d median_session_usd:d median_calls:d pct_of_agent_sessions:d pct_of_agent_usd:d",
    "t13_by_mode": "mode:s outcome:s sessions:l usd:d median_human_turns:d median_tool_calls:d pct_of_all_usd:d",
    "t13_headline": "abandoned_sessions:l pct_of_sessions_abandoned:d usd_abandoned:d pct_of_total_usd_abandoned:d usd_zero_committed_lines:d usd_no_attribution:d median_usd_of_an_abandoned_session:d",
    "t13_most_expensive_abandoned": "session_id:s agent:s repo:s mode:s session_cost_usd:d n_calls:l n_human_turns:l n_tool_calls:l outcome:s",
    "t13_size_of_abandoned_sessions": "usd_bucket:s abandoned_sessions:l usd:d median_calls:d median_human_turns:d",
    "t13_where_do_they_die": "outcome:s sessions:l usd:d median_position_of_last_prompt:d usd_weighted_median_position:d",
    "t14_concentration_by_repo": "repo:s files:l edits:l pct_of_edits_in_top_5pct_of_files:d pct_of_edits_in_top_20pct_of_files:d",
    "t14_edits_by_agent": "agent:s edits:l pct_edits_followed_by_error:d pct_edits_followed_by_short_correction:d",
    "t14_headline": "hot_files:l pct_of_edits_on_hot_files:d pct_hot_file_edits_followed_by_error:d pct_cold_file_edits_followed_by_error:d edits_total:l median_repo_share_of_edits_in_top_5pct_of_files:d",
    "t14_hot_vs_cold": "heat:s files:l edits:l avg_pct_edits_followed_by_error:d avg_pct_edits_followed_by_short_correction:d median_edits_per_file:d pct_of_all_edits:d",
    "t14_hot_vs_cold_weighted": "heat:s edits:l pct_edits_followed_by_error:d pct_edits_followed_by_short_correction:d",
    "t14_top30_hot_files": "repo:s file_path_70:s agent:s sessions:l users:l edits:l pct_edits_followed_by_error:d pct_edits_followed_by_short_correction:d",
    "t15_by_agent_model_family": "agent:s model_family:s sessions:l usd:d committed_lines:l usd_per_committed_line:d ctx_tokens_per_committed_line:d output_tokens_per_committed_line:d",
    "t15_by_mode": "mode:s agent:s sessions:l usd:d committed_lines:l usd_per_committed_line:d",
    "t15_by_repo_agent": "repo:s agent:s sessions:l usd:d committed_lines:l usd_per_committed_line:d",
    "t15_headline": "cheapest_agent_per_committed_line:s cheapest_usd_per_committed_line:d dearest_agent_per_committed_line:s dearest_usd_per_committed_line:d ratio_dearest_to_cheapest:d repos_with_two_or_more_agents:l",
    "t16_headline": "sidechain_calls:l sidechain_usd:d pct_of_claude_code_usd:d task_tool_calls:l task_result_chars:l sessions_using_task:l",
    "t16_sessions_with_vs_without": "kind:s mode:s sessions:l usd:d pct_sessions_with_commits:d committed_lines:l usd_per_committed_line:d median_session_usd:d",
    "t16_sidechain_share": "agent:s calls:l sidechain_calls:l pct_calls_sidechain:d usd:d sidechain_usd:d pct_usd_sidechain:d",
    "t16_task_tool_usage": "agent:s task_calls:l sessions:l result_chars:l usd_of_the_task_prompts:d median_result_chars:d",
    "t17_by_permission_mode": "permission_mode:s sessions:l usd:d committed_lines:l usd_per_committed_line:d tool_error_rate_pct:d tool_calls_per_committed_line:d pct_sessions_with_commits:d median_session_usd:d",
    "t17_by_permission_mode_and_mode": "permission_mode:s mode:s sessions:l usd:d usd_per_committed_line:d tool_error_rate_pct:d",
    "t17_headline": "sessions_on_bypass:l usd_on_bypass:d usd_per_committed_line_bypass:d usd_per_committed_line_default:d tool_error_rate_pct_bypass:d tool_error_rate_pct_default:d",
    "t18_headline": "interrupts:l sessions_with_at_least_one_interrupt:l usd_sunk_before_interrupts:d pct_of_total_usd:d usd_per_committed_line_interrupted_sessions:d usd_per_committed_line_calm_sessions:d queue_operation_events:l",
    "t18_interrupts_by_agent": "agent:s interrupts:l sessions_with_interrupts:l sunk_usd:d median_sunk_usd:d median_sunk_calls:d pct_of_total_usd:d",
    "t18_queue_operations": "agent:s sessions_with_queue_events:l queue_events:l median_queue_events_per_session:d",
    "t18_sessions_with_vs_without_interrupts": "kind:s mode:s sessions:l usd:d committed_lines:l usd_per_committed_line:d pct_sessions_with_commits:d median_calls:d",
    "t19_boundaries_by_subtype": "agent:s event_kind:s boundaries:l sessions:l",
    "t19_headline": "reads_in_the_20_tool_calls_after_a_boundary:l pct_of_those_reads_already_seen:d reread_chars:l usd_of_the_rereads_first_pass_only:d usd_of_the_rereads_at_cache_write_price:d compaction_boundaries:l sessions_with_a_boundary:l",
    "t19_rereads_after_boundary": "agent:s event_kind:s reads_in_next_20_tool_calls:l reads_of_already_seen_paths:l pct_rereads:d reread_chars:l reread_usd_one_pass:d reread_usd_recached:d",
    "t19_sessions_with_compaction": "agent:s sessions:l sessions_with_a_boundary:l pct_sessions_compacted:d max_boundaries:l usd_in_compacted_sessions:d median_boundaries_when_present:d",
    "t19_top_reread_files": "file_path_80:s rereads_after_a_boundary:l sessions:l chars:l",
    "t20_edit_thrash": "agent:s edits:l edits_in_a_thrash_window:l pct_of_edits:d distinct_thrashed_files:l",
    "t20_headline": "reads_of_a_just_written_file:l pct_of_all_reads:d reread_chars:l usd_at_fresh_input_price:d edits_inside_a_thrash_window:l pct_of_edits_in_thrash:d",
    "t20_self_rereads": "agent:s reads:l reads_within_5_calls_of_a_write:l pct_of_reads:d reread_chars:l usd_fresh_input_price:d",
    "t20_top_thrashed_files": "file_path_80:s agent:s edits_in_thrash_windows:l sessions:l worst_burst:l",
    "t21_fast_by_month": "month:t fast_calls:l calls:l pct_fast:d fast_usd:d",
    "t21_fast_sessions_vs_standard": "kind:s sessions:l usd:d usd_per_committed_line:d median_agent_time_s_per_turn:d",
    "t21_headline": "fast_calls:l pct_of_claude_code_calls:d fast_usd:d pct_of_claude_code_usd:d sessions_using_fast:l pct_of_calls_without_a_speed_field:d",
    "t21_speed_share": "speed:s calls:l sessions:l usd:d output_tokens:l pct_of_calls:d pct_of_usd:d",
    "t22_headline": "user_repo_pairs_that_switched_models:l models_involved:l sessions:l usd:d usd_per_committed_line_overall:d median_dearest_to_cheapest_ratio_within_a_pair:d",
    "t22_model_totals_within_switchers": "session_model:s user_repo_cells:l sessions:l usd:d committed_lines:l usd_per_committed_line:d output_tokens_per_committed_line:d",
    "t22_pairs": "user_hash:s repo:s session_model:s sessions:l usd:d committed_lines:l usd_per_committed_line:d ctx_tokens_per_committed_line:d",
    "t22_within_pair_comparison": "user_hash:s repo:s cheapest_model:s cheapest_usd_per_line:d dearest_model:s dearest_usd_per_line:d ratio:d",
    "t23_by_hour_bucket": "hour_bucket:s sessions:l usd:d tool_error_rate_pct:d abandonment_rate_pct:d usd_per_committed_line:d median_session_usd:d pct_of_sessions:d",
    "t23_by_timezone": "timezone:s offset_min:l sessions:l usd:d pct_started_at_night:d",
    "t23_headline": "codex_sessions_with_a_timezone:l pct_of_sessions_started_at_night:d pct_of_codex_usd_spent_at_night:d abandonment_rate_pct_night:d abandonment_rate_pct_day:d usd_per_committed_line_night:d usd_per_committed_line_day:d median_session_usd_night:d",
    "t23_sessions_per_local_hour": "local_hour:l sessions:l usd:d tool_error_rate_pct:d abandonment_rate_pct:d usd_per_committed_line:d",
    "t24_by_version_claude_code": "harness_version:s vkey:s sessions:l attachment_chars_per_session:d human_chars_per_session:d pct_injected:d",
    "t24_headline": "harness_attachment_chars:l harness_attachment_tokens:d all_event_payload_chars:l attachment_events:l human_typed_chars:l pct_of_prompt_side_written_by_the_harness:d",
    "t24_injected_by_subtype": "agent:s event_type:s subtype:s events:l payload_chars:l payload_tokens:d median_payload_chars:d",
    "t24_injected_vs_human_by_agent": "agent:s injected_chars:l attachment_chars:l human_chars:l pct_injected_of_prompt_side:d pct_attachments_of_prompt_side:d",
    "t24_per_session_distribution": "agent:s sessions:l max_attachment_chars:l median_attachment_chars_per_session:d p90_attachment_chars_per_session:d",
    "task_per_session": "task_calls_bucket:s sessions:l task_calls:l result_Mchars:d",
    "task_vs_no_task": "mode:s kind:s sessions:l usd_per_committed_line:d pct_with_commit:d median_usd:d",
    "unread_by_next_label": "label:s replies:l unread:l pct_unread:d unread_long_over_3000_chars:l median_reply_chars:d median_delta_s:d",
    "cost_by_label": "label:s turns:l usd:d median_turn_usd:d median_calls:d pct_of_bill:d",
    "pushback_cost": "turns:l usd_after_fix_requests:d pct_after_fix_requests:d usd_after_pushback:d pct_after_pushback:d",
    "bill_summary": "line_no:l item:s usd:d pct_of_total_usd:d running_usd:d total_usd:d",
    "ingest_claude_code_calls": "session_id:s seq:l agent:s model:s output_tokens:l n_text_chars:l n_tool_uses:l text_head:s stop_reason:s",
    "ingest_claude_code_tool_calls": "session_id:s seq:l agent:s msg_id:s tool_use_id:s tool_name:s tool_kind:s file_path_raw:s file_path:s command_head:s input_chars:l old_string_chars:l new_string_chars:l "
                                     "read_offset:l read_limit:l result_chars:l result_hash:s is_error:b error_head:s result_latency_ms:l",
    "probe_result_texts": "session_id:s seq:l tool_use_id:s text:s",
    "probe_reply_texts_claude_code": "session_id:s seq:l msg_id:s text:s",
    "probe_reply_texts_cursor": "session_id:s seq:l msg_id:s text:s",
    "probe_reply_texts_opencode": "session_id:s seq:l msg_id:s text:s",
    "probe_drops": "probe:s reason:s items:l sampled:l",
    "probe_large_sample": "doc_id:l lang:s",
    "ingest_inventory": "session_id:s agent:s fmt:s status:s filled:b",
    "ingest_document_messages": "session_id:s version:s directory:s seq:l role:s text:s",
    "ingest_files_calls": "session_id:s seq:l agent:s model:s output_tokens:l n_text_chars:l n_tool_uses:l text_head:s stop_reason:s",
    "ingest_files_turns": "session_id:s seq:l agent:s text:s chars:l human_chars:l is_meta:b is_interrupt:b is_slash_command:b",
    "ingest_files_totals": "agent:s calls:l tool_calls:l user_turns:l events:l sessions:l bad_lines:l",
    "ingest_errors": "session_id:s line_no:l exception:s",
    "ingest_records": "session_id:s seq:l a:l",
    "ingest_codex_calls": "session_id:s seq:l agent:s model:s output_tokens:l n_text_chars:l n_tool_uses:l text_head:s stop_reason:s",
    "ingest_cursor_calls": "session_id:s seq:l agent:s model:s output_tokens:l n_text_chars:l n_tool_uses:l text_head:s stop_reason:s",
    "ingest_opencode_calls": "session_id:s seq:l agent:s model:s output_tokens:l n_text_chars:l n_tool_uses:l text_head:s stop_reason:s",
    "ingest_claude_code_turns": "session_id:s seq:l agent:s text:s chars:l human_chars:l is_meta:b is_interrupt:b is_slash_command:b",
    "ingest_codex_turns": "session_id:s seq:l agent:s text:s chars:l human_chars:l is_meta:b is_interrupt:b is_slash_command:b",
    "ingest_cursor_turns": "session_id:s seq:l agent:s text:s chars:l human_chars:l is_meta:b is_interrupt:b is_slash_command:b",
    "ingest_opencode_turns": "session_id:s seq:l agent:s text:s chars:l human_chars:l is_meta:b is_interrupt:b is_slash_command:b",
    "ingest_totals": "agent:s calls:l tool_calls:l user_turns:l events:l sessions:l bad_lines:l",
    "ingest_claude_code_events": "session_id:s seq:l event_type:s subtype:s payload_chars:l",
    "probe_read_measures": "doc_id:l result_chars:l n_lines:l style:s n_prefixed_lines:l prefix_chars:l prefix_share:d prefixed_line_share:d",
    "probe_final_measures": "doc_id:l text_chars:l n_lines:l n_headers:l n_bullets:l n_fences:l header_chars:l bullet_chars:l summary_chars:l summary_share:d bullet_share:d",
    "probe_write_measures": "doc_id:l ext:s json_bytes:l json_overhead_bytes:l json_overhead_share:d string_leaf_chars:l content_chars:l n_newlines:l n_quotes:l indent_chars:l newline_share:d quote_share:d indent_share:d",
    "probe_bash_measures": "doc_id:l agent:s result_chars:l result_bytes:l gzip_bytes:l gzip_ratio:d bucket:s",
    "probe_read_by_agent": "agent:s sampled:l mean_share:d char_weighted_share:d mean_prefixed_line_share:d median_share:d median_lines:d",
    "probe_read_by_style": "style:s sampled:l result_chars:l char_weighted_prefix_share:d share_of_results:d",
    "probe_write_by_ending": "ext:s sampled:l char_weighted_overhead_share:d newline_share:d quote_share:d indent_share:d median_overhead_share:d median_content_chars:d median_input_bytes:d",
    "probe_write_by_tool": "agent:s tool_kind:s sampled:l char_weighted_overhead_share:d newline_share:d quote_share:d indent_share:d median_overhead_share:d median_content_chars:d median_input_bytes:d",
    "probe_bash_by_bucket": "bucket:s sampled:l result_chars:l median_ratio:d median_chars:d share_of_results:d share_of_result_chars:d",
    "probe_bash_by_agent": "agent:s sampled:l mean_ratio:d share_of_chars_over_10:d median_ratio:d",
    "probe_final_by_language": "lang:s sampled:l mean_headers:d mean_bullets:d mean_fences:d bullet_char_share:d summary_char_share:d structured:l median_chars:d median_headers:d median_bullets:d",
    "probe_populations": "probe:s agent:s model:s n_items:l population_chars:l",
    "probe_extrapolation_lineno_prefixes": "measure:s agent:s model:s n_items:l population_chars:l sample_share:d wasted_chars:d wasted_tokens:d price_usd_per_mtok:d usd:d priced:b",
    "probe_extrapolation_image_base64": "measure:s agent:s model:s n_items:l population_chars:l sample_share:d wasted_chars:d wasted_tokens:d price_usd_per_mtok:d usd:d priced:b",
    "probe_extrapolation_json_overhead": "measure:s agent:s model:s n_items:l population_chars:l sample_share:d wasted_chars:d wasted_tokens:d price_usd_per_mtok:d usd:d priced:b",
    "probe_extrapolation_newlines_and_indent": "measure:s agent:s model:s n_items:l population_chars:l sample_share:d wasted_chars:d wasted_tokens:d price_usd_per_mtok:d usd:d priced:b",
    "probe_extrapolation_high_ratio_results": "measure:s agent:s model:s n_items:l population_chars:l sample_share:d wasted_chars:d wasted_tokens:d price_usd_per_mtok:d usd:d priced:b",
    "probe_extrapolation_compressible_redundancy": "measure:s agent:s model:s n_items:l population_chars:l sample_share:d wasted_chars:d wasted_tokens:d price_usd_per_mtok:d usd:d priced:b",
    "probe_extrapolation_summary_sections": "measure:s agent:s model:s n_items:l population_chars:l sample_share:d wasted_chars:d wasted_tokens:d price_usd_per_mtok:d usd:d priced:b",
    "probe_extrapolation_bullets": "measure:s agent:s model:s n_items:l population_chars:l sample_share:d wasted_chars:d wasted_tokens:d price_usd_per_mtok:d usd:d priced:b",
    "probe_coverage": "probe:s sampled:l measured:l hit_rate:d",
    "prompt_context": "session_id:s agent:s repo:s seq:l prompt:s prev_text:s prev_tools:s",
    "label_requests": "batch_no:l request_id:s n_items:l first:s text:s est_out_tokens:l",
    "label_pending": "request_id:s batch_no:l n_items:l",
    "label_work_estimate": "model:s requests:l input_tokens:l output_tokens:l cost_usd:d",
    "label_rows": "session_id:s agent:s seq:l label:s pushback:b sentiment:s language:s mentions_file:b model:s",
    "label_repairs": "field:s coerced:l invalid:l first_bad_value:s",
    "label_distribution": "label:s claude_code:l codex:l cursor:l opencode:l total:l",
    "label_pushback_rate": "agent:s prompts:l pushback:l rate:d",
    "label_languages": "language:s prompts:l share:d",
    "label_file_mentions": "mentions_file:l prompts:l share:d",
    "label_sentiments": "sentiment:s prompts:l share:d",
    "slice_opencode": "session_id:s focus:l slice:s first_seq:l last_seq:l",
    "slice_claude_code_cut": "session_id:s focus:l slice:s first_seq:l last_seq:l",
    "slice_opencode_cut": "session_id:s focus:l slice:s first_seq:l last_seq:l",
    "slice_cursor": "session_id:s focus:l slice:s first_seq:l last_seq:l",
    "slice_codex": "session_id:s focus:l slice:s first_seq:l last_seq:l",
    "slice_claude_code": "session_id:s focus:l slice:s first_seq:l last_seq:l",
    "slice_skips": "reason:s cases:l",
    "verdict_rates": "stratum:s cases:l hits:l population:l rate:d low:d high:d extrapolated:d",
    "verdict_rows": "session_id:s seq:l case_type:s stratum:s was_full_rewrite_needed:b estimated_lines_actually_changed:l reason:s model:s cost_usd:d",
    "verdict_summary": "stratum:s cases:l hits:l population:l rate:d low:d high:d extrapolated:d",
    "verdict_causes": "cause:s n:l pct:d",
    "synthetic_cases": "session_id:s seq:l k_before:l k_after:l stratum:s population_n:l",
    "reconcile_sessions": "session_id:s n_calls:l sum_output_tokens:l sum_output_net:l n_tool_calls:l n_user_turns:l n_user_turns_all:l agent:s stat_assistant_messages:l stat_output_tokens:l stat_tool_calls:l stat_user_messages:l ckpt_api_call_count:l ckpt_output_tokens:l",
    "reconcile_agreement": "metric:s agent:s sessions:l ledger_total:l metadata_total:l exact:l metadata_zero:l median_rel_delta:d",
    "reconcile_worst": "session_id:s agent:s metric:s ours:l theirs:l rel_delta:d",
}
